"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every four bytes of a text are a feature, hashed into 2**BITS buckets. The raw multinomial counts all documents, the target multinomial those of a bounded
number of trusted labelled rows (at most `trusted`, in the order of a hash of their id). A text's verdict is the mean over its features of
log(target share / raw share) against a fixed threshold; nothing is drawn at random, so one text always gets one verdict.

Null text: no words. Empty texts fail the base rule (fewer than 50 words). With no trusted row all ratios are 0. Documents or labels given twice count twice
in the corpus counts and are judged alike; a document is trusted if any row of its id is. Only doc_id and text are read, and doc_id and quality of labels.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import map_arrow, pieces, texts_of, trim
from undula.llm.words import Words, grams, mix

BITS, GRAM = 16, 4
#: Trusted rows that the target is fitted on, at most; so many ids are broadcast.
TRUSTED = 20_000
THRESHOLD = -0.35
#: Added to a bucket's target count and to the count expected of the raw corpus: rare features say little.
SMOOTHING = 4.0
#: Base rule: words at least, and the share of words in repeated windows at most, in per cent.
MIN_WORDS, MAX_REPEATED = 50, 50
_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b"#*$%&|<>")] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of four bytes, and the text that it belongs to; a text stands between line ends."""
    b = np.frombuffer(b"".join(b"\n" + t + b"\n" for t in texts), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(t) + 2 for t in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    if len(b) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (b[:-3] << np.uint64(24)) | (b[1:-2] << np.uint64(16)) | (b[2:-1] << np.uint64(8)) | b[3:]
    own = doc[:-3] == doc[3:]
    key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - BITS)).astype(np.int64)[own], doc[:-3][own]


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def count_features(docs: DataFrame) -> DataFrame:
    """bucket, raw, target over all rows of docs (text, trusted boolean)."""

    def run(batches):
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in pieces(batches):
            f, doc = features(_bytes(batch))
            trusted = np.array([bool(x) for x in batch.column("trusted").to_pylist()])
            raw += np.bincount(f, minlength=1 << BITS)
            target += np.bincount(f[trusted[doc]], minlength=1 << BITS)
        on = np.flatnonzero(raw)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(target[on])], names=["bucket", "raw", "target"])
        trim()

    counts = docs.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> np.ndarray:
    """The log ratio of each bucket: 2**BITS numbers whatever the input."""
    ids = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("trusted", F.lit(True))
    marked = texts_of(docs).join(F.broadcast(ids), "doc_id", "left")  # at most `trusted` ids
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r in count_features(marked).toLocalIterator():  # at most 2**BITS rows
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return np.zeros(1 << BITS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = Words(texts)
    n = len(texts)
    doc = np.repeat(np.arange(n), w.counts)
    begin = np.concatenate(([0], np.cumsum((w.buf & 0xC0) != 0x80)))
    out = {"n_words": w.counts.astype(np.int64), "word_chars": np.bincount(doc, weights=begin[w.end] - begin[w.start], minlength=n).astype(np.int64)}
    signs = np.concatenate(([0], np.cumsum(_SIGNS[w.buf])))
    out["n_symbols"] = (signs[w.begin[1:]] - signs[w.begin[:-1]]).astype(np.int64)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(dup, dtype=np.int64)
    h = w.hashes()
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(h) >= 3:
        g = grams(h, 3)
        at = np.flatnonzero(w.inside(3)[: len(g)])
        key = mix(g[at] ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(h) + 3, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 3, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover)[: len(h)] > 0], minlength=n).astype(np.int64)
    return out


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log ratio) and kept."""
    rows = texts_of(docs)
    shared = rows.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _bytes(batch)
        base = base_counts(texts)
        f, doc = features(texts)
        llr = np.bincount(doc, weights=shared.value[f], minlength=len(texts)) / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[c]) for c in names), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))], names=["doc_id", *names, "base_failed", "llr", "kept"])

    return map_arrow(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, llr double, kept boolean")
