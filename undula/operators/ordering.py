"""Numbers and running sums over a global order without a global window.

Rows are dealt by ranges of the order and sorted within each range; a range's place in the whole is the sum of the sizes of those before it. Only these sizes, one
number for each range, ever meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.storage import materialize

#: monotonically_increasing_id has the partition above this bit and the row's place in it below.
_BIT = 33


def _offsets(ranges: DataFrame, key: str, size: str) -> DataFrame:
    """key, _first: the sum of size over smaller keys. One row for each range."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select(key, F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_first"))


def _dealt(df: DataFrame, order: tuple, parts: int | None) -> DataFrame:
    """df in ranges of the order, written with `_at`, each row's range and place in it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def numbered(df: DataFrame, name: str, *order: Column | str, start: int = 0, parts: int | None = None) -> DataFrame:
    """df with its rows' numbers (long, dense, from start) in the order given; rows that the order can't tell apart are numbered in any order.

    Equal rows of the order fall into one range: name further columns where many rows may be equal. df is read twice (ranges are sampled), so write it first if it
    is costly. The columns `_at`, `_range` and `_first` are used inside and must not be in df.
    """
    rows = _dealt(df, order, parts).withColumn("_range", F.shiftright("_at", _BIT))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    out = rows.join(F.broadcast(_offsets(sizes, "_range", "_n")), "_range")  # as many rows as ranges
    at = F.col("_at").bitwiseAND(F.lit((1 << _BIT) - 1))
    return out.select(*df.columns, (F.col("_first") + at + start).cast("long").alias(name))


def running_sum(df: DataFrame, name: str, value: Column, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over all rows up to and with each row of the order, which must tell rows apart.

    Each range is summed by a window of its own; the sums of the ranges before come by a join on the range. Columns as in numbered().
    """
    rows = _dealt(df.withColumn("_v", value), order, parts).withColumn("_range", F.shiftright("_at", _BIT))
    sums = rows.groupBy("_range").agg(F.sum("_v").alias("_n"))
    own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_own", F.sum("_v").over(own)).join(F.broadcast(_offsets(sums, "_range", "_n")), "_range")  # as many rows as ranges
    return out.select(*df.columns, (F.col("_first") + F.col("_own")).alias(name))
