"""BPE encoding and decoding that equals a tokenizer file's own, with long unsplit text joined as a tree.

Words between white space are encoded once per worker and kept in a bounded table. A word longer than `leaf` symbols is cut into leaves; leaves are encoded
apart (in a thread pool), then joined in pairs, level by level. At a join the last k tokens of the left and the first k of the right are encoded again as one
window, k growing until the window begins with the left's own token and ends with the right's own token. Neighbouring tokens that stay apart when their two
texts are encoded together stay apart in the whole, so such a join is exact.

Null text counts as empty; an empty text has no tokens. Repeated rows are encoded again, one result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from undula.llm.common import map_arrow, texts_of

#: Entries of a worker's table of words; it is emptied when full. The byte-level encoder learns a word faster, so that its table can be small.
CACHE, BYTE_CACHE = 400_000, 40_000
#: Longer words are encoded by the tree and not kept.
LEAF = 256
#: White space of the tokenizer's patterns (fixed values); Python's own set has four more control characters.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROL = re.compile("[\x1c-\x1f]")


class Merges:
    """Greedy pair merging by rank over a list of symbols."""

    def __init__(self, model: dict):
        self.vocab = model["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}

    def merge(self, symbols: list[str]) -> list[str]:
        s, n, rank = list(symbols), len(symbols), self.rank
        if n < 2:
            return s
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := rank.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = a + b, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((s[x], s[y]))) is not None:
                    heapq.heappush(heap, (r, x, s[x], s[y]))
        return [x for x in s if x]


def tree_merge(symbols: list[str], merges: Merges, split, leaf: int = LEAF, pool: ThreadPoolExecutor | None = None) -> list[str]:
    """merges.merge(symbols) by halves. split(token) gives a token's symbols again."""
    leaves = [symbols[i : i + leaf] for i in range(0, len(symbols), leaf)] or [[]]
    run = (lambda f, x: list(pool.map(f, x))) if pool else (lambda f, x: list(map(f, x)))
    level = run(merges.merge, leaves)

    def join(pair):
        left, right = pair
        k = 2
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = merges.merge([s for t in [*left[len(left) - a :], *right[:b]] for s in split(t)])
            if (a == len(left) or window[0] == left[len(left) - a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[: len(left) - a] + window + right[b:]
            k *= 2

    while len(level) > 1:
        odd = [level.pop()] if len(level) % 2 else []
        level = run(join, list(zip(level[0::2], level[1::2], strict=True))) + odd
    return level[0]


class Encoder:
    """encode(text) -> ids as little-endian unsigned 32-bit integers, and decode, for a BPE file with or without word ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        spec = self.spec()
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.pool = ThreadPoolExecutor(2)

    def spec(self) -> dict:
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def merges(self) -> Merges:
        """Of use for long words alone, so read when one comes."""
        return Merges(self.spec()["model"])

    @cached_property
    def names(self) -> list[str]:
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]

    def symbols(self, piece: str) -> list[str]:
        s = list(piece)
        if self.end and s:
            s[-1] += self.end
        return s

    def split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            s = list(token[: -len(self.end)])
            s[-1] += self.end
            return s
        return list(token)

    def long(self, word: str) -> list[int]:
        """A long word's ids: its own pre-tokens, each joined as a tree."""
        text = self.tokenizer.normalizer.normalize_str(word) if self.tokenizer.normalizer else word
        out: list[int] = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
            s = self.symbols(piece)
            parts = tree_merge(s, self.merges, self.split, pool=self.pool) if len(s) > LEAF else self.merges.merge(s)
            out += [self.merges.vocab[t] for t in parts]
        return out

    def learn(self, words: set[str]) -> None:
        """Put the words' ids into the table."""
        new = list(words)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = e.ids
            self.ids[w] = struct.pack(f"<{len(ids)}I", *ids)
            self.shown[w] = " ".join([self.names[i] for i in ids])

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special)

    def encode_words(self, text: str) -> tuple[bytes, str]:
        """The ids of a text whose tokenizer drops white space, and its decoding (token names joined by a space)."""
        if not self.plain(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids), self.tokenizer.decode(ids, skip_special_tokens=False)
        words = text.split() if not _CONTROL.search(text) else [w for w in _SPACE.split(text) if w]
        if not words:
            return b"", ""
        if max(map(len, words)) > LEAF:
            parts, shown = [], []
            for w in words:
                if len(w) > LEAF:
                    ids = self.long(w)
                    parts.append(struct.pack(f"<{len(ids)}I", *ids))
                    shown.append(" ".join(self.names[i] for i in ids))
                else:
                    if w not in self.ids:
                        self.learn({w})
                    parts.append(self.ids[w])
                    shown.append(self.shown[w])
            return b"".join(parts), " ".join(filter(None, shown))
        new = {w for w in set(words) if w not in self.ids}
        if new:
            if len(self.ids) + len(new) > CACHE:
                self.ids.clear()
                self.shown.clear()
                new = set(words)
            self.learn(new)
        return b"".join(map(self.ids.__getitem__, words)), " ".join(filter(None, map(self.shown.__getitem__, words)))


#: A space with white space before it and white space or the end after it: no cut before it.
_RUN = re.compile(r"\s (?=\s|\Z)")


#: A word of Latin letters with ASCII signs behind it: two pre-tokens at most.
_SIMPLE = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ž]+)([.,;:!?|#$%&*-]*)")


class ByteEncoder(Encoder):
    """For a byte-level tokenizer that keeps white space: text is cut before spaces, where its pattern always cuts.

    A pre-token is merged by the ranks of the file's own vocabulary, in which a merge's rank is the id that it makes.
    """

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        codes = {c: b for b, c in enumerate(_byte_names())}
        ranks = {bytes(codes[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.core = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            got = self.core.encode_single_piece(text.encode())
            ids = struct.pack(f"<{len(got)}I", *got)
            if len(self.pieces) >= BYTE_CACHE:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def forget(self) -> None:
        """Empty the tables: a worker outlives its tasks."""
        self.ids.clear()
        self.pieces.clear()
        self.__dict__.pop("merges", None)

    def learn(self, words: set[str]) -> None:
        odd = []
        for w in words:
            m = _SIMPLE.fullmatch(w)
            if m:
                a, b = m.groups()
                self.ids[w] = self.piece(a) + (self.piece(b) if b else b"")
            else:
                odd.append(w)
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.ids[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def encode_text(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.plain(text) or _RUN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _BEFORE.split(text)
        if not parts[0]:
            parts = parts[1:]
        new = {w for w in set(parts) if w not in self.ids}
        if new:
            if max(map(len, new)) > LEAF:
                return b"".join(map(self._one, parts))
            if len(self.ids) + len(new) > BYTE_CACHE:
                self.ids.clear()
                new = set(parts)
            self.learn(new)
        return b"".join(map(self.ids.__getitem__, parts))

    def _one(self, part: str) -> bytes:
        if len(part) <= LEAF:
            if part not in self.ids:
                if len(self.ids) >= BYTE_CACHE:
                    self.ids.clear()
                self.learn({part})
            return self.ids[part]
        ids = self.long(part)
        return struct.pack(f"<{len(ids)}I", *ids)


_BEFORE = re.compile("(?= )")


def _byte_names() -> list[str]:
    """The printable character by which byte-level vocabularies name each byte: itself where printable, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str, kind: type = Encoder) -> Encoder:
    return kind(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        out = [enc.encode_words(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(a) // 4 for a, _ in out], pa.int64()), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return map_arrow(texts_of(docs), run, "doc_id long, n_tokens long, ids binary, decoded string")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """encode_documents with SHA-256 digests in place of the ids and the decoded text, made in the same pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        n, a, b = [], [], []
        for t in batch.column("text").to_pylist():
            ids, shown = enc.encode_words(t or "")
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(shown.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
