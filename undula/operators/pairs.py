"""Similarity joins of contours and prototypes.

Lengths decide first: a warp is tried only if the longer has fewer than w times the points of the shorter, less one. That is an equi-join: lengths fall into buckets whose
limits are powers of w, and what may meet lies in the same bucket or the next. The exact rule is checked above it, still below the warp, so hopeless pairs never
reach Python. One side is broadcast only if it is_few; else both are shuffled, each bucket dealt over many tasks by a salt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import kernels
from undula.functions.contours import length_ratio_ok, ratio, valid_weight
from undula.storage import few, materialize

#: Prototypes that may be broadcast, and their points in all; beyond either both sides are shuffled.
FEW, FEW_POINTS = 20_000, 8_000_000

#: Points of contours that are compared at a time.
_CELLS = 1 << 16


def is_few(prototypes: DataFrame, column: str = "weight") -> bool:
    """Whether prototypes may be sent to every task."""
    r = prototypes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("points")).first()
    return r.n <= FEW and r.points <= FEW_POINTS


def length_bucket(n: Column, w: int) -> Column:
    """Lengths that may be warped onto each other differ by one bucket at most; null for no points."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(float(w)))).cast("int")


def length_join(left: DataFrame, right: DataFrame, a: str, b: str, w: int = 3) -> DataFrame:
    """Every pair of rows whose arrays a (of left) and b (of right) have lengths that allow a warp; right is broadcast if it is few.

    Otherwise each row of right goes to three buckets times as many salts as give every core work; rows of left are dealt over the salts at random.
    """
    few = is_few(right, b)
    salts = 1 if few else max(1, -(-int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2))
    own = length_bucket(F.size(a), w)
    x = left.withColumns({"_bucket": own, "_salt": F.floor(F.rand(7) * salts).cast("int") if salts > 1 else F.lit(0)}).filter("_bucket is not null")
    at = length_bucket(F.size(b), w)
    y = right.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).filter("_bucket is not null")
    return x.join(F.broadcast(y) if few else y, ["_bucket", "_salt"]).filter(length_ratio_ok(F.size(a), F.size(b), w)).drop("_bucket", "_salt")


def near_counts(contours: DataFrame, w: int = 3) -> DataFrame:
    """a (contour_id), n_near (how many other contours its length could be warped onto), shortest and longest of them; contours without one have no row. contours: contour_id (one row each), n (points).

    Lengths alone decide, so no pair of contours is formed: different lengths meet, each with the number of its contours. As each length takes that many points of its own, their pairs are
    at most twice as many as there are points.
    """
    own = contours.filter("contour_id is not null")
    lengths = materialize(own.groupBy("n").agg(F.count("*").alias("times")).withColumn("_bucket", length_bucket(F.col("n"), w)).filter("_bucket is not null"))
    x = lengths.select(F.col("n").alias("m"), "_bucket")
    met = x.join(lengths.withColumn("_bucket", F.explode(F.array(*(F.col("_bucket") + k for k in (-1, 0, 1))))), "_bucket")
    others = F.col("times") - F.when(F.col("m") == F.col("n"), 1).otherwise(0)
    met = met.withColumn("times", others).filter(length_ratio_ok(F.col("m"), F.col("n"), w) & (F.col("times") > 0))
    near = materialize(met.groupBy("m").agg(F.sum("times").alias("n_near"), F.min("n").alias("shortest"), F.max("n").alias("longest")))
    return own.join(few(near), F.col("n") == F.col("m")).select(F.col("contour_id").alias("a"), "n_near", "shortest", "longest")


def every_pair(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """All pairs of two frames of which the result has a row each: right is broadcast if few, else given to each of as many tasks as left is dealt over."""
    if few:
        return left.crossJoin(F.broadcast(right))
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = left.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    return x.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), "_salt").drop("_salt")


def with_warp(pairs: DataFrame, ref: str, other: str, w: int = 3, variant: str = "banded") -> DataFrame:
    """pairs with similarity and warp (array<int>) of the two array columns, a batch of pairs at a time."""
    names = pairs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                found = kernels.dtw_pairs(b.column(ref).to_pylist(), b.column(other).to_pylist(), w, variant)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=[*names, "similarity", "warp"])

    return pairs.mapInArrow(run, f"{kinds}, similarity double, warp array<int>")


def compare(contours: DataFrame, prototypes: DataFrame, w: int = 3, bias: float = 0.0, variant: str = "banded") -> DataFrame:
    """contour_id, category, similarity, warp, activation of every contour with every prototype; pairs that lengths rule out have no row.

    contours: contour_id, freq. prototypes: category, weight.
    """
    p = prototypes.select("category", valid_weight(F.col("weight")).alias("weight"))
    both = length_join(contours.select("contour_id", "freq"), p, "freq", "weight", w)
    out = with_warp(both, "weight", "freq", w, variant)
    return out.select("contour_id", "category", "freq", "weight", "similarity", "warp", (F.col("similarity") * (1 - bias)).alias("activation"))


def similarities(contours: DataFrame, prototypes: DataFrame, w: int = 3, bias: float = 0.0) -> DataFrame:
    """contour_id, category, similarity and activation as in compare(), without the warps.

    Prototypes that are few go to the tasks, where contours pass by once and those of one length are compared together with the prototypes of one length.
    """
    p = materialize(prototypes.select("category", valid_weight(F.col("weight")).alias("weight")).filter("size(weight) > 0"))
    if not is_few(p):
        return compare(contours, p, w, bias).select("contour_id", "category", "similarity", "activation")
    refs = p.toArrow().combine_chunks()  # checked to be few
    names, weights = refs.column("category").combine_chunks(), refs.column("weight").to_pylist()
    sizes = np.array([len(x) for x in weights], dtype=np.int64)
    together = [(m, own := np.flatnonzero(sizes == m), np.array([weights[k] for k in own.tolist()], dtype=float)) for m in np.unique(sizes).tolist()]

    def run(batches):
        for b in batches:
            freq = b.column("freq")
            size = np.array(freq.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            values = freq.flatten().to_numpy(zero_copy_only=False).astype(float)
            first = np.cumsum(size) - size
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == n)
                for m, own, refs in together:
                    if not (m == n == 1 or kernels.length_ratio(m, n) < w):
                        continue
                    some = max(1, _CELLS // (n * len(own)))
                    for at in range(0, len(rows), some):
                        part = rows[at : at + some]
                        for k in range(0, len(own), max(1, _CELLS // n)):  # as many references as there may be
                            few_ = own[k : k + max(1, _CELLS // n)]
                            found = kernels.scores(refs[k : k + len(few_)], values[first[part][:, None] + np.arange(n)], w)
                            category, contour = np.repeat(few_, len(part)), np.tile(part, len(few_))
                            yield pa.RecordBatch.from_arrays([b.column("contour_id").take(pa.array(contour)), names.take(pa.array(category)), pa.array(found.ravel())], names=["contour_id", "category", "similarity"])

    kinds = {f.name: f.dataType.simpleString() for f in (*contours.select("contour_id").schema, *p.select("category").schema)}
    out = contours.select("contour_id", "freq").mapInArrow(run, f"contour_id {kinds['contour_id']}, category {kinds['category']}, similarity double")
    return out.withColumn("activation", F.col("similarity") * (1 - bias))


def prototype_pairs(prototypes: DataFrame, w: int = 3, ordered: bool = True) -> DataFrame:
    """i, j, similarity of prototypes: all ordered pairs with 100 on the diagonal, or only i < j (similarity is not symmetric; the reference is i). Pairs that lengths rule out have 0.

    Only pairs that can be warped carry their values; the others come from a product of the prototypes' names and lengths.
    """
    p = prototypes.select("category", F.coalesce(valid_weight(F.col("weight")), F.array().cast("array<double>")).alias("weight"))
    a, b = p.select(F.col("category").alias("i"), F.col("weight").alias("a")), p.select(F.col("category").alias("j"), F.col("weight").alias("b"))
    wanted = F.col("i") != F.col("j") if ordered else F.col("i") < F.col("j")
    out = with_warp(length_join(a, b, "a", "b", w).filter(wanted), "a", "b", w).select("i", "j", "similarity")
    m, n = a.select("i", F.size("a").alias("m")), b.select("j", F.size("b").alias("n"))
    apart = every_pair(m, n, is_few(p)).filter(wanted & ~length_ratio_ok(F.col("m"), F.col("n"), w))
    out = out.unionByName(apart.select("i", "j", F.lit(0.0).alias("similarity")))
    return out.unionByName(a.select("i", F.col("i").alias("j"), F.lit(100.0).alias("similarity"))) if ordered else out


def similarity_long(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair's point-wise similarities: the other columns, i, j, similarity."""
    keep = [c for c in pairs.columns if c not in (a, b)]
    left = pairs.select(*keep, b, F.posexplode(a).alias("i", "x"))
    return left.select(*keep, "i", "x", F.posexplode(b).alias("j", "y")).select(*keep, "i", "j", ratio(F.col("x"), F.col("y")).alias("similarity"))


def warp_band(m: int, n: int, w: int, spark) -> DataFrame:
    """i, j_lo, j_hi: the columns that each row of a table of m x n may use, by the general rule."""
    rows = spark.range(m).select(F.col("id").cast("int").alias("i"))
    lo = F.greatest(F.lit(0), F.floor((F.col("i") + 1) / w) - 1, (F.col("i") - m) * w + n)
    hi = F.least(w * (F.col("i") + 1), F.bround((F.col("i") - m) / w + n)) - 1
    return rows.select("i", lo.cast("int").alias("j_lo"), F.least(hi, F.lit(n - 1)).cast("int").alias("j_hi"))


def path_rows(warped: DataFrame, *keep: str) -> DataFrame:
    """i, j and the point's similarity along each warp; warped has freq (input), weight (reference) and warp."""
    rows = warped.filter(F.size("warp") > 0).select(*keep, "freq", "weight", F.posexplode("warp").alias("i", "j"))
    return rows.select(*keep, "i", "j", ratio(F.get("weight", F.col("i")), F.get("freq", F.col("j"))).alias("similarity"))


def first_compatible(contours: DataFrame, w: int = 3, head: int = 50) -> DataFrame:
    """The first two of the first `head` contours whose lengths are within a factor of w."""
    c = contours.select("contour_id", F.size("freq").alias("n")).filter("n > 0").orderBy("contour_id").limit(head)
    a, b = c.toDF("a", "n_a"), c.toDF("b", "n_b")
    return a.join(b, (F.col("a") < F.col("b")) & (F.greatest("n_a", "n_b") / F.least("n_a", "n_b") < w)).orderBy("a", "b").limit(1)
