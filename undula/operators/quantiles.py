"""Exact quantiles of any number of values, without a buffer of them.

A quantile lies between two values of known ranks. Each pass cuts the range of values that may have such a rank at pivots (a sketch's quantiles, of bounded size), counts
the values on and between pivots, and keeps the part with the rank; values equal to a pivot are a part of their own, so that ties end a search instead of stalling it. When a
part has few enough values, they are sorted. Groups and their two ranks go side by side; what passes from pass to pass is one row for each of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.contours import finite
from undula.storage import few, materialize

#: Values of one range that are sorted at once; pivots of a pass.
SORTED, PIVOTS = 10_000, 32
_STATE = ("rank", "low", "high", "below", "inside")


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values inside each range of state."""
    s = few(state).withColumnsRenamed({k: f"{k}_s" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_s"))
    return rows.join(s, on & F.col("x").between(F.col("low"), F.col("high"))).drop(*(f"{k}_s" for k in keys))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], pivots: int) -> DataFrame:
    grid = [i / pivots for i in range(pivots + 1)]
    sketch = _within(rows, state, keys).groupBy(*keys, *_STATE).agg(F.array_distinct(F.percentile_approx("x", grid, 100 * pivots)).alias("pivots"))
    part = 2 * F.size(F.filter("pivots", lambda p: p < F.col("x"))) + F.array_contains("pivots", F.col("x")).cast("int")
    parts = _within(rows, materialize(sketch), keys).groupBy(*keys, *_STATE, part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("l"), F.max("x").alias("h"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 2 * pivots + 3 rows each
    placed = parts.withColumn("to", F.col("below") + before).filter((F.col("to") <= F.col("rank")) & (F.col("rank") < F.col("to") + F.col("n")))
    return placed.select(*keys, "rank", F.col("l").alias("low"), F.col("h").alias("high"), F.col("to").alias("below"), F.col("n").alias("inside"))


def quantile(df: DataFrame, value: Column, *by: str, q: float = 0.5, name: str = "quantile", most: int = SORTED, pivots: int = PIVOTS) -> DataFrame:
    """by, name: the q-quantile (0 to 1, interpolated between neighbours) of the finite values in each group, null groups included; without groups one row, null if there is no value."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    own = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_k0")]
    rows = materialize(df.select(*own, value.cast("double").alias("x")).filter(finite(F.col("x"))))
    at = F.lit(q) * (F.col("inside") - 1)
    ends = rows.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("inside"))
    share = materialize(ends.select(*keys, (at - F.floor(at)).alias("share")))
    state = ends.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at))))).withColumn("below", F.lit(0).cast("long")).select(*keys, *_STATE)
    state = materialize(state)
    wide = (F.col("low") < F.col("high")) & (F.col("inside") > most)
    while not state.filter(wide).isEmpty():
        state = materialize(state.filter(~wide).unionByName(_narrowed(rows, materialize(state.filter(wide)), keys, pivots)))
    equal, rest = F.col("low") == F.col("high"), materialize(state.filter("low < high"))
    picked = _within(rows, rest, keys).groupBy(*keys, "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # at most `most` values each
    found = state.filter(equal).select(*keys, "rank", F.col("low").alias("x")).unionByName(picked.select(*keys, "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
    pair = found.groupBy(*keys).agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"))
    on = [pair[k].eqNullSafe(share[k]) for k in keys]
    out = pair.join(few(share), on).select(*(pair[k] for k in keys), (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias(name))
    if not by:
        return out.agg(F.max(name).alias(name))
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), name)
