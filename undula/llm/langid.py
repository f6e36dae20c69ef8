"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased letters with every run of other characters as one gap. Four symbols are a gram. The training rows' grams are counted per language over all
rows (counted per task, then summed), and every lower order follows from the distinct grams. The models are sorted arrays of gram hashes with one column of
log probabilities per language. A text gets the language of lowest cross-entropy per symbol; it is accepted if that is at most the model's own mean plus
`slack` nats plus `spread` standard errors at the text's length, both moments taken from all training grams.

Null text or text without a letter: lang `und`, score 0.0, not accepted. Ties go to the first language in sorted order. With no training row every text is
`und`. Repeated rows are judged alike; null languages don't train; columns other than text (and lang in training) are never looked at.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import crc_mod, map_arrow, pieces, texts_of, trim
from undula.llm.words import mix

ORDER = 4
#: Nats per symbol, and standard errors, that an accepted text may lie above its language's mean.
SLACK, SPREAD = 1.0, 6.0
#: The score is a softmax over the languages at this many symbols.
SHARPNESS = 20.0


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """A 16-bit symbol for each code point: 0 for a gap, else the lower-case letter; letters past U+FFFF share the private use area."""
    out = np.zeros(0x110000, dtype=np.uint16)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            out[c] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all grams, the text each belongs to, and each text's number of letters."""
    pad = "\n" * (ORDER - 1)
    cps = np.frombuffer("".join(pad + (t or "") + "\n" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    begin = np.cumsum([0] + [len(t or "") + ORDER for t in texts])
    s = _fold()[cps]
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))
    keep = s != 0
    keep[1:] |= s[:-1] != 0  # the first of a run of gaps
    keep[(begin[:-1, None] + np.arange(ORDER - 1)).ravel()] = True
    letters = np.bincount(doc[s != 0], minlength=len(texts))
    s, doc = s[keep].astype(np.uint64), doc[keep]
    if len(s) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    n = len(s) - ORDER + 1
    key = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(16)) | s[k : k + n]
    same = doc[:n] == doc[ORDER - 1 :]
    return key[same], doc[:n][same], letters


def count_grams(train: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of train (text, lang)."""

    def run(batches):
        kept: dict[str, list] = {}

        def squeeze(lang):
            keys = np.concatenate([k for k, _ in kept[lang]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in kept[lang]])[order]
            at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            kept[lang] = [(keys[at], np.add.reduceat(n, at))]

        for batch in pieces(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            key, doc, _ = symbols(batch.column("text").to_pylist())
            for lang in set(langs.tolist()):
                k, n = np.unique(key[(langs == lang)[doc]], return_counts=True)
                if len(k):
                    kept.setdefault(lang, []).append((k, n))
                    if len(kept[lang]) >= 8:
                        squeeze(lang)
        for lang in kept:
            squeeze(lang)
            k, n = kept[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        trim()

    rows = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class HashTable:
    """A sorted array of hashes with an index over their leading bits; find() gives positions, -1 where a key is missing."""

    BITS = 16

    def __init__(self, keys: np.ndarray):
        h = mix(keys.copy())
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.first = np.searchsorted(self.hashes, np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)).astype(np.int32)
        self.most = int(np.diff(np.append(self.first, len(h))).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(keys), -1)
        h = mix(keys.copy())
        at = self.first[(h >> np.uint64(64 - self.BITS)).astype(np.int64)].astype(np.int64)
        top = len(self.hashes) - 1
        np.minimum(at, top, out=at)
        open_ = np.flatnonzero(self.hashes[at] < h)
        for _ in range(self.most):
            if not len(open_):
                break
            at[open_] = np.minimum(at[open_] + 1, top)
            open_ = open_[(self.hashes[at[open_]] < h[open_]) & (at[open_] < top)]
        at[self.hashes[at] != h] = -1
        return at


@dataclass
class Model:
    """tables[n]: grams of n+1 symbols, their log probabilities by language; backs[n]: contexts of n+1 symbols, their log back-off weights."""

    langs: list[str]
    tables: list[HashTable]
    logs: list[np.ndarray]
    backs: list[HashTable]
    weights: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    def score(self, key: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last symbol, a row per gram and a column per language."""
        out = np.zeros((len(key), len(self.langs)), dtype=np.float32)
        open_ = np.arange(len(key))
        for n in range(ORDER - 1, -1, -1):
            k = key[open_] & np.uint64((1 << 16 * (n + 1)) - 1)
            at = self.tables[n].find(k)
            hit = at >= 0
            out[open_[hit]] += self.logs[n][at[hit]]
            open_, k = open_[~hit], k[~hit]
            if not len(open_):
                return out
            if n:
                at = self.backs[n - 1].find(k >> np.uint64(16))
                hit = at >= 0
                out[open_[hit]] += self.weights[n - 1][at[hit]]
        out[open_] += self.floor
        return out


def _ids(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model of each language from (lang, grams, counts), all of its grams."""
    rows = sorted(rows)
    langs = [r[0] for r in rows]
    union = np.unique(np.concatenate([g for _, g, _ in rows])) if rows else np.zeros(0, np.uint64)
    grams = [union]
    for n in range(ORDER - 1, 0, -1):
        grams.insert(0, np.unique(grams[0] & np.uint64((1 << 16 * n) - 1)))
    contexts = [np.unique(g >> np.uint64(16)) for g in grams[1:]]
    logs = [np.zeros((len(g), len(langs))) for g in grams]
    weights = [np.zeros((len(c), len(langs))) for c in contexts]
    floor, mean, sd = (np.zeros(len(langs)) for _ in range(3))
    size = len(grams[0]) + 1
    for j, (_, g, c) in enumerate(rows):
        order = np.argsort(g)
        own, count = [g[order]], [c[order].astype(float)]
        for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols in front
            k, inv = _ids(own[0] & np.uint64((1 << 16 * n) - 1))
            own.insert(0, k)
            count.insert(0, np.bincount(inv).astype(float))
        below = None
        for n in range(ORDER):
            k, x = own[n], count[n]
            ones, twos = (x == 1).sum(), (x == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            if n == 0:
                total = x.sum()
                base = d * len(k) / total / size
                p = np.full(len(grams[0]), base)
                p[np.searchsorted(grams[0], k)] += np.maximum(x - d, 0) / total
                floor[j] = np.log(base)
            else:
                ctx, inv = _ids(k >> np.uint64(16))
                total = np.bincount(inv, weights=x)
                lam = np.ones(len(contexts[n - 1]))
                lam[np.searchsorted(contexts[n - 1], ctx)] = d * np.bincount(inv) / total
                weights[n - 1][:, j] = np.log(lam)
                low = np.searchsorted(grams[n - 1], grams[n] & np.uint64((1 << 16 * n) - 1))
                p = lam[np.searchsorted(contexts[n - 1], grams[n] >> np.uint64(16))] * below[low]
                p[np.searchsorted(grams[n], k)] += np.maximum(x - d, 0) / total[inv]
            below = p
            logs[n][:, j] = np.log(p)
        cost = -logs[ORDER - 1][np.searchsorted(union, own[-1]), j]
        share = count[-1] / count[-1].sum()
        mean[j] = (share * cost).sum()
        sd[j] = np.sqrt((share * (cost - mean[j]) ** 2).sum())
    tables, backs = [HashTable(g) for g in grams], [HashTable(c) for c in contexts]
    f32 = lambda x, t: x[t.order].astype(np.float32)
    return Model(langs, tables, [f32(x, t) for x, t in zip(logs, tables, strict=True)], backs, [f32(x, t) for x, t in zip(weights, backs, strict=True)], floor.astype(np.float32), mean, sd)


def train(docs: DataFrame) -> Model:
    """A model from all rows of docs (text, lang)."""
    got = count_grams(docs).toPandas()
    return fit([(lang, part["gram"].to_numpy().view(np.uint64), part["n"].to_numpy()) for lang, part in got.groupby("lang")])


def identify(docs: DataFrame, model: Model, *keep: str, slack: float = SLACK, spread: float = SPREAD) -> DataFrame:
    """doc_id, the columns in keep (text may be one), lang_pred, score, cross_entropy (per symbol, null for und) and accepted."""
    rows = texts_of(docs, *(c for c in keep if c != "text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        texts = batch.column("text").to_pylist()
        key, doc, letters = symbols(texts)
        n, k = len(texts), len(m.langs)
        length = np.bincount(doc, minlength=n)
        if k:
            s = m.score(key)
            cost = np.stack([-np.bincount(doc, weights=s[:, j], minlength=n) for j in range(k)], axis=1) / np.maximum(length, 1)[:, None]
            best = cost.argmin(axis=1)
            low = cost[np.arange(n), best]
            score = 1 / np.exp(-SHARPNESS * (cost - low[:, None])).sum(axis=1)
            ok = low <= m.mean[best] + slack + spread * m.sd[best] / np.sqrt(np.maximum(length, 1))
        else:
            best, low, score, ok = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        none = (letters == 0) | (k == 0)
        pred = ["und" if x else m.langs[b] for x, b in zip(none, best, strict=True)]
        own = [batch.column(c) for c in ("doc_id", *keep)]
        return pa.RecordBatch.from_arrays([*own, pa.array(pred), pa.array(np.where(none, 0.0, score)), pa.array(low, mask=none), pa.array(ok & ~none)], names=["doc_id", *keep, "lang_pred", "score", "cross_entropy", "accepted"])

    return map_arrow(rows, run, f"{kinds}, lang_pred string, score double, cross_entropy double, accepted boolean")


def trained_apart(docs: DataFrame) -> DataFrame:
    """The rows that a held-out test may learn from: crc32 of doc_id modulo 4 is not 2."""
    return docs.filter(crc_mod("doc_id", 4) != 2)
