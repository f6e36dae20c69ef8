"""Helpers that the operators share: Arrow mapping, split rules, and undula.storage's materialize."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.storage import materialize

#: Rows of text are worked on in pieces of about this many bytes, whatever the size of the Arrow batch.
PIECE_BYTES = 1 << 20
#: A side of a join is broadcast up to so many rows; larger ones are shuffled.
SMALL = 200_000


def few(small: DataFrame) -> DataFrame:
    """small, marked for a broadcast if it has at most SMALL rows (it is a written table, so that counting is cheap); else both sides are shuffled."""
    return F.broadcast(small) if small.count() <= SMALL else small


def texts_of(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id as long, text as string and the columns named; anything else that docs carries is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def trim() -> None:
    """Give freed memory back: a Python worker outlives its tasks, and its allocator keeps what they held."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at, size = 0, 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        yield batch.slice(at)


@contextmanager
def small_batches(spark: SparkSession, limit: int = PIECE_BYTES) -> Iterator[None]:
    """What runs inside sends rows to Python in Arrow batches of about `limit` bytes (one row at least), not of 10,000 rows; JVM and worker hold two at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """Apply f to each piece of df's rows; f returns a record batch or None."""

    def run(batches):
        for piece in pieces(batches, column):
            out = f(piece)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for plans that it can't size or that join (where it multiplies), the measured bytes of text."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size > 1 << 52 or "Join" in plan.toString():
        size = df.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    return size
