"""Exact substring dedup by prefix-partitioned suffix trees over words.

A window is `window` consecutive words of one document. A word goes if a window that covers it also starts earlier (in a smaller doc_id, or earlier in the same
document). All windows are judged on the input.

The suffixes that the trees hold are those at anchors: of the first `prefix` words of all suffixes inside a window, the one with the smallest hash is the
window's anchor, so equal windows have equal anchors at equal places, and a suffix at an anchor, with the words up to its left that its windows need, stands for
all of them. Suffixes are split by prefix:

1. Documents are dealt by a hash of doc_id into groups of bounded size. Within a group equal windows are found by a 64-bit hash and confirmed by a second one;
   all but the first of equals are decided there, and what is left holds any window once.
2. Each group sends the prefixes of its anchors with their number. A prefix that only one group has is a leaf: nothing below it repeats, and its suffixes are
   never sent. The others are returned to the groups that have them. A prefix of more than `crowded` suffixes is made longer, to the full window.
3. The groups send the suffixes of repeated prefixes. Prefixes are gathered into memory-sized sets; in each set the suffix trees are grown level by level by
   naming the words, pairs of words, 4, 8, 16 and then `window` words of every suffix (equal names: one node). The leaves below a node of depth `window` are
   the occurrences of a repeat; all but the earliest are decided. Names compare the words themselves, not hashes.
4. Decisions, as runs of window starts, go back to the documents' groups.

A window that half of all documents share is sent once by each group, not once by each document. The documents are shuffled once, for all three passes.

Null text has no word. Documents shorter than a window stay whole. Rows with one doc_id are neither earlier nor later than each other at equal starts, so
exact repeats of a row all stay (or all go for an earlier document's sake). Null ids come before all others. Other columns are ignored.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import plan_bytes, texts_of, trim
from undula.llm.words import Words, grams

WINDOW, PREFIX = 20, 6
#: Bytes of a group of documents, about; suffixes of one prefix before it is made longer.
GROUP_BYTES, CROWDED = 4 << 20, 20_000
_NO_ID = -(1 << 63)


def _windows(h: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    g = grams(h, window)
    g[~inside[: len(g)]] = 0
    return g


def _first_of_equals(keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each entry, whether an entry of an equal key has a smaller rank."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    if new.all():
        return np.zeros(len(keys), dtype=bool)
    at = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(rank[order], at), np.diff(np.append(at, len(k))))
    out = np.empty(len(keys), dtype=bool)
    out[order] = rank[order] > low
    return out


class Group:
    """The documents of a group in the order of their ids, with anchors and the windows that the group decides itself."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], window: int = WINDOW, prefix: int = PREFIX, index: bool = True):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        self.order = order
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] or b"" for i in order]
        self.window, self.prefix = window, prefix
        self.words = w = Words(self.texts)
        self.lost = np.zeros(len(w), dtype=bool)  # by window start
        self.at = np.zeros(0, dtype=np.int64)
        if not index or len(w) < window:
            return
        h = w.hashes()
        inside = w.inside(window)
        self.at = at = np.flatnonzero(inside)
        if not len(at):
            return
        doc = np.repeat(np.arange(len(self.ids)), w.counts)
        same = np.array([0] + [int(a != b) for a, b in zip(self.ids[1:], self.ids[:-1], strict=True)])
        self.doc = doc
        self.begin = w.at[:-1]
        rank = (np.cumsum(same)[doc[at]] << 32) + (at - self.begin[doc[at]])
        key = grams(h, window)[at]
        lost = _first_of_equals(key, rank)
        if lost.any():  # confirm by a second hash
            maybe = np.flatnonzero(np.isin(key, key[lost]))
            second = grams(w.hashes(1), window)[at[maybe]]
            both = np.unique(np.stack([key[maybe], second]), axis=1, return_inverse=True)[1].ravel().astype(np.uint64)
            lost[:] = False
            lost[maybe] = _first_of_equals(both, rank[maybe])
        self.lost[at[lost]] = True
        self.key = np.zeros(len(w), dtype=np.uint64)
        self.key[at] = key
        self._anchors(h)

    def _anchors(self, h: np.ndarray) -> None:
        """Runs of window starts with one anchor: first, number, prefix hash; only runs that hold an undecided window, cut to these."""
        g = grams(h, self.prefix)
        n = len(g)
        low, pos, width, span = g.copy(), np.arange(n), 1, self.window - self.prefix + 1
        while width < span:
            step = min(width, span - width)
            better = low[step:] < low[: n - step]
            pos[: n - step] = np.where(better, pos[step:], pos[: n - step])
            low[: n - step] = np.where(better, low[step:], low[: n - step])
            width += step
        at = self.at[~self.lost[self.at]]
        anchor = pos[at]
        if not len(at):
            self.first = self.last = np.zeros(0, np.int64)
            self.prefixes = np.zeros(0, np.uint64)
            return
        cut = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        self.first = at[cut]
        self.last = at[np.concatenate((cut[1:], [True]))]
        self.prefixes = g[anchor[cut]]

    def prefix_counts(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.unique(self.prefixes, return_counts=True)

    def runs(self, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(document's place in the group, first window, number) of sorted window starts."""
        if not len(starts):
            return []
        doc = self.doc[starts]
        cut = np.flatnonzero(np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1]))))
        size = np.diff(np.append(cut, len(starts)))
        return list(zip(doc[cut].tolist(), (starts[cut] - self.begin[doc[cut]]).tolist(), size.tolist(), strict=True))

    def text_of(self, a: int, b: int) -> bytes:
        """The words a..b-1, one space between."""
        w = self.words
        return b" ".join(w.joined[w.start[a] : w.end[b - 1]].split())


_SENT = pa.schema([("set", pa.int64()), ("grp", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("suffix", pa.binary())])
_SENT_DDL = "set long, grp long, place long, doc_id long, start long, n long, suffix binary"
_LOST_DDL = "grp long, place long, start long, n long"


def _group(table: pa.Table, window: int, prefix: int, index: bool = True) -> Group:
    return Group(table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), window, prefix, index)


def _grow(suffixes: list[bytes], n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the nodes of depth `window`: for each window of each suffix (row, window within it, name)."""
    number: dict[bytes, int] = {}
    words, size = [], []
    for s in suffixes:
        own = s.split(b" ")
        size.append(len(own))
        words += [number.setdefault(x, len(number)) for x in own]
    name = np.array(words, dtype=np.int64)
    begin = np.cumsum([0, *size])
    depth = 1
    steps = [1 << k for k in range(window.bit_length()) if 2 << k <= window]
    levels = {1: name}
    for d in steps:  # depth d -> 2d
        here = levels[d][: len(levels[d]) - d] * np.int64(1 << 31) + levels[d][d:]
        levels = {2 * d: np.unique(here, return_inverse=True)[1]}
        depth = 2 * d
    name = levels[depth]
    if depth < window:  # two overlapping nodes make the last level
        shift = window - depth
        name = np.unique(name[: len(name) - shift] * np.int64(1 << 31) + name[shift:], return_inverse=True)[1]
    row = np.repeat(np.arange(len(suffixes)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, within, name[begin[:-1][row] + within]


def decide(table: pa.Table, window: int) -> list[tuple[int, int, int, int]]:
    """(grp, place, start, n) of the windows of a set of suffixes that also start earlier."""
    n = table.column("n").to_numpy()
    grp, place, start = (table.column(c).to_numpy() for c in ("grp", "place", "start"))
    ids = np.array([_NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
    row, within, name = _grow(table.column("suffix").to_pylist(), n, window)
    at = start[row] + within
    order = np.lexsort((at, ids[row], name))
    new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    lost = np.zeros(len(order), dtype=bool)
    o, f = order, order[head]
    lost[o] = (ids[row[o]] != ids[row[f]]) | (at[o] != at[f])
    row, at = row[lost], at[lost]
    if not len(row):
        return []
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))))
    return list(zip(grp[row[cut]].tolist(), place[row[cut]].tolist(), at[cut].tolist(), np.diff(np.append(cut, len(row))).tolist(), strict=True))


def removals(docs: DataFrame, finish, schema: str, window: int = WINDOW, prefix: int = PREFIX, crowded: int = CROWDED) -> DataFrame:
    """finish(group, gone) for each group of documents, as a table of `schema`: gone has a flag per word. docs: doc_id, text and columns that finish may want."""
    spark = docs.sparkSession
    groups = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * plan_bytes(docs) // GROUP_BYTES))
    dealt = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    by_group = dealt.groupBy("grp")

    def count(key, table):
        trim()
        prefixes, n = _group(table, window, prefix).prefix_counts()
        return pa.table({"prefix": pa.array(prefixes.view(np.int64)), "grp": pa.array(np.full(len(n), key[0].as_py(), dtype=np.int64)), "n": pa.array(n.astype(np.int64))})

    def send(key, table, wanted):
        trim()
        g, grp = _group(table, window, prefix), key[0].as_py()
        rows = [(i % groups, grp, p, None, s, n, None) for i, (p, s, n) in enumerate(g.runs(np.flatnonzero(g.lost)), start=grp)]
        if len(wanted) and len(g.at):
            prefixes = wanted.column("prefix").to_numpy().view(np.uint64)
            order = np.argsort(prefixes)
            longer = wanted.column("longer").to_numpy(zero_copy_only=False)[order]
            prefixes = prefixes[order]
            spot = np.minimum(np.searchsorted(prefixes, g.prefixes), len(prefixes) - 1)
            for i in np.flatnonzero(prefixes[spot] == g.prefixes):
                a, b, p = int(g.first[i]), int(g.last[i]) + 1, int(g.doc[g.first[i]])
                start = a - int(g.begin[p])
                if longer[spot[i]]:
                    rows += [(int(g.key[s]) % groups, grp, p, g.ids[p], start + s - a, 1, g.text_of(s, s + window)) for s in range(a, b) if not g.lost[s]]
                else:
                    rows.append((int(g.prefixes[i]) % groups, grp, p, g.ids[p], start, b - a, g.text_of(a, b - 1 + window)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENT, strict=True)], schema=_SENT)

    def grow(_, table):
        trim()
        known = pc.is_null(table.column("suffix"))
        done = table.filter(known)
        rows = list(zip(*(done.column(c).to_pylist() for c in ("grp", "place", "start", "n")), strict=True))
        rest = table.filter(pc.invert(known))
        if len(rest):
            rows += decide(rest, window)
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("grp", "place", "start", "n"), cols, strict=True)})

    def end(key, table, lost):
        trim()
        g = _group(table, window, prefix, index=False)
        cover = np.zeros(len(g.words) + window + 1, dtype=np.int64)
        if len(lost):
            place, start, n = (lost.column(c).to_numpy() for c in ("place", "start", "n"))
            at = g.words.at[:-1][place] + start
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n + window - 1, -1)
        return finish(g, np.cumsum(cover)[: len(g.words)] > 0, table)

    counted = by_group.applyInArrow(count, "prefix long, grp long, n long")
    # a prefix's groups: as many as there are groups at most
    shared = counted.groupBy("prefix").agg(F.collect_list("grp").alias("grps"), F.sum("n").alias("n")).filter(F.size("grps") > 1)
    wanted = shared.select("prefix", F.explode("grps").alias("grp"), (F.col("n") > crowded).alias("longer"))
    sent = by_group.cogroup(wanted.groupBy("grp")).applyInArrow(send, _SENT_DDL)
    lost = sent.groupBy("set").applyInArrow(grow, _LOST_DDL)
    return by_group.cogroup(lost.groupBy("grp")).applyInArrow(end, schema)


def word_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space between)."""

    def finish(g: Group, gone: np.ndarray, _) -> pa.Table:
        sha, removed = [], []
        w = g.words
        for d in range(len(g.ids)):
            flags = gone[w.at[d] : w.at[d + 1]]
            k = int(flags.sum())
            own = g.texts[d].split()
            if k:
                own = [x for x, f in zip(own, flags.tolist(), strict=True) if not f]
            removed.append(k)
            sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return removals(texts_of(docs), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def without_repeats(docs: DataFrame, *keep: str, window: int = WINDOW) -> DataFrame:
    """doc_id, the columns in keep, text (without the removed words; untouched where none go), n_words and n_removed.

    Kept stretches keep their own white space and are joined by one space.
    """

    rows = texts_of(docs, *keep)
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)

    def finish(g: Group, gone: np.ndarray, table: pa.Table) -> pa.Table:
        others = table.take(pa.array(g.order))
        texts, removed = [], []
        w = g.words
        for d in range(len(g.ids)):
            a, b = int(w.at[d]), int(w.at[d + 1])
            flags = gone[a:b]
            removed.append(int(flags.sum()))
            if not removed[-1]:
                texts.append(g.texts[d])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([True], flags, [True])).astype(np.int8)))
            texts.append(b" ".join(w.joined[w.start[a + s] : w.end[a + e - 1]] for s, e in zip(edge[0::2], edge[1::2], strict=True)))
        return pa.table({"doc_id": pa.array(g.ids, pa.int64())} | {c: others.column(c) for c in keep} | {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed, pa.int64())})

    return removals(rows, finish, f"doc_id long, {kinds}text string, n_words long, n_removed long", window)
