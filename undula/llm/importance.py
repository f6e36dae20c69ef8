"""Importance resampling of documents towards a target distribution of hashed features.

Features are all runs of 1 to `RUN` words (joined by one space, repeats counted); a feature's bucket is the crc32 of its UTF-8 bytes modulo `BUCKETS`. The sparse
document-by-bucket count matrix is written as CSR blocks, about a megabyte of text each, few to a file. Column sums of the blocks give the bucket distributions of the corpus and of
the target; their smoothed log ratio is a bucket's gain; a sparse product of each block with the gains gives each document's weight, the floored mean gain of its
features. Weights plus Gumbel noise by id are scores, whose highest share is drawn, so that a document is drawn in proportion to its importance without replacement.

All rows count, whatever their id. Null texts and texts without a word have no features and weight 0. Texts of any length are read in slices, so a task holds a slice
and one counter per bucket. A null id is hashed as the empty text and ranks after others of its score; rows of one id and score rank in any order. Empty tables give
no rows, and a target without features gives gains by smoothing alone. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import materialize, pieces, trim
from undula.operators.ordering import numbered

BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text that are split into words at once.
_SLICE = 1 << 20
#: Blocks of a written file. A Parquet reader decodes up to 4,096 rows of a file together, whatever their size, so files are what bounds the blocks that a task holds.
FILE_BLOCKS = 16
_BLOCK = "doc_ids array<bigint>, words array<bigint>, starts array<int>, buckets array<smallint>, counts array<int>"


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about _SLICE bytes, cut only between words."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + _SLICE)
        to = cut.end() if cut else len(text)
        yield text[at:to]
        at = to


def features(text: bytes, run: int = RUN, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """How many words a text has, the buckets of its features in order, and how often it has each."""
    n, total, before = 0, None, [[] for _ in range(run - 1)]  # before[k]: crc32 of the last run of k + 1 words and a space
    keys = counts = np.zeros(0, np.int64)
    for part in slices(text):
        words = _WORD.findall(part.lower())
        if not words:
            continue
        n += len(words)
        crcs = list(map(crc32, words))
        found = [np.array(crcs, dtype=np.int64)]
        for k in range(run - 1):
            # runs of k + 2 words: one more word after each run of k + 1; the run before a slice's first word lies in the slice before
            spaced = before[k] + [crc32(b" ", c) for c in crcs]
            crcs = list(map(crc32, words[len(words) + 1 - len(spaced) :] if len(spaced) <= len(words) else words, spaced[:-1]))
            before[k] = spaced[-1:]
            found.append(np.array(crcs, dtype=np.int64))
        own, times = np.unique(np.concatenate(found) % buckets, return_counts=True)
        if len(keys):
            total = np.zeros(buckets, np.int64) if total is None else total
            total[keys] = counts
            total[own] += times
            own = np.flatnonzero(total)
            times = total[own]
        keys, counts = own, times
    return n, keys, counts


def matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """The count matrix as CSR blocks: doc_ids, words (a number for each document), starts (of each document's entries, and their end), buckets, counts."""
    if not 1 <= buckets <= 1 << 15:
        raise ValueError("there may be 1 to 32768 buckets")
    types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int16()), pa.list_(pa.int32())]

    def go(batches):
        for b in pieces(batches):
            found = [features((t or "").encode(), run, buckets) for t in b.column("text").to_pylist()]
            starts = np.cumsum([0] + [len(k) for _, k, _ in found])
            flat = lambda i, kind: np.concatenate([f[i] for f in found]).astype(kind)
            block = [b.column("doc_id").to_pylist(), [f[0] for f in found], starts.astype(np.int32), flat(1, np.int16), flat(2, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, types, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])
        trim()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(go, _BLOCK)


def _flat(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket. Each task sums its blocks; the sums of tasks are added by a shuffle, and one number a bucket comes back."""

    def go(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                np.add.at(total, _flat(b.column("buckets"), row), _flat(b.column("counts"), row))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("buckets", "counts").mapInArrow(go, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed shares of the target and of the corpus."""
    all_s, all_t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + b) / ((s + 1.0) * (all_t + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: the product of the blocks with the gains."""

    def go(batches):
        for b in batches:
            for row in range(b.num_rows):
                starts, counts = _flat(b.column("starts"), row), _flat(b.column("counts"), row).astype(np.int64)
                sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[starts])
                n = sums(counts)
                weight = np.where(n > 0, sums(counts * gain[_flat(b.column("buckets"), row)]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[row].values, b.column("words")[row].values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(go, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise), from the first 32 bits of the sha256 of `<seed>:<id>`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank, from 1 for the highest score; null for rows that aren't drawn.

    percent of the documents of at least least_words words are drawn. They are ranked by ranges of the score, never in one place; the row's place in `weighed` parts rows
    that are alike, so that no range is one crowd of equals.
    """
    rows = materialize(weighed.withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long")).withColumn("place", F.monotonically_increasing_id()))
    may = rows.filter(F.col("n_words") >= least_words)
    most = may.count() * percent // 100
    ranked = numbered(may, "rank", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place"), start=1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    out = ranked.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """draw() of docs (doc_id, text) by their importance for the texts of target (text)."""
    blocks = materialize(matrix(docs), FILE_BLOCKS)
    wanted = matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    return draw(weigh(blocks, gains(column_sums(blocks), column_sums(wanted))), percent, least_words, seed)
