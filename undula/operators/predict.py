"""Read-only assignment of contours to prototypes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import kernels
from undula.functions.contours import gather, match, valid_weight
from undula.operators.pairs import compare, is_few

#: Contours that are assigned together.
_TOGETHER = 256


def rank(activations: DataFrame) -> DataFrame:
    """activations with rank (0: highest activation, ties by category)."""
    w = Window.partitionBy("contour_id").orderBy(F.desc("activation"), "category")
    return activations.withColumn("rank", F.row_number().over(w) - 1)


def best(activations: DataFrame) -> DataFrame:
    """contour_id, category, activation of the highest activation, ties by the smaller category; aggregated before it is shuffled."""
    top = activations.groupBy("contour_id").agg(F.max_by(F.struct("category", "activation"), F.struct("activation", (-F.col("category")).alias("c"))).alias("x"))
    return top.select("contour_id", "x.*")


def first_resonating(ranked: DataFrame, vigilance: float) -> DataFrame:
    """contour_id, category and match of the first in rank order whose match is above vigilance; without one, no category and the best match."""
    hit = F.col("match") > vigilance
    return ranked.groupBy("contour_id").agg(F.min_by(F.when(hit, F.col("category")), F.when(hit, F.col("rank"))).alias("category"), F.coalesce(F.min_by(F.when(hit, F.col("match")), F.when(hit, F.col("rank"))), F.max("match")).alias("match"))


def nearest(contours: DataFrame, prototypes: DataFrame, bias: float = 0.0, w: int = 3, variant: str = "banded") -> DataFrame:
    """contour_id, category, similarity, match, n_candidates, n_warped of each contour's prototype of the highest activation, ties by the smaller category.

    n_candidates counts the prototypes that lengths allow (without one all else is null), n_warped those that were warped: the others' bounds show that they score
    less. Prototypes within pairs.is_few go to the tasks, where contours pass by once, without a shuffle; of more, all pairs are warped.
    """
    p = prototypes.select("category", valid_weight(F.col("weight")).alias("weight"))
    if not is_few(p):
        compared = compare(contours, prototypes, w, bias, variant).withColumn("match", match(gather(F.col("freq"), F.col("warp")), F.col("weight")))
        top = compared.groupBy("contour_id").agg(F.max_by(F.struct("category", "similarity", "match"), F.struct("activation", (-F.col("category")).alias("c"))).alias("x"), F.count("*").alias("n"))
        n = F.coalesce("n", F.lit(0))
        return contours.select("contour_id").join(top, "contour_id", "left").select("contour_id", "x.*", n.alias("n_candidates"), n.alias("n_warped"))
    rows = sorted(((r.category, r.weight) for r in p.collect()), key=lambda r: r[0])  # checked to be few
    names, refs = [c for c, _ in rows], [x for _, x in rows]

    def run(batches):
        bounds = kernels.Bounds(refs, w, variant)
        for big in batches:
            for at in range(0, big.num_rows, _TOGETHER):
                b = big.slice(at, _TOGETHER)
                out = []
                inputs = b.column("freq").to_pylist()
                for i, x, found in zip(b.column("contour_id").to_pylist(), inputs, kernels.nearest([x or [] for x in inputs], bounds, 1 - bias), strict=True):
                    if found is None:
                        out.append((i, None, None, None, 0, 0))
                    else:
                        r, s, warp, n, warped = found
                        out.append((i, names[r], s, kernels.match([x[j] for j in warp], refs[r]), n, warped))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=list(fields))

    kinds = {f.name: f.dataType.simpleString() for f in contours.select("contour_id").schema} | {f.name: f.dataType.simpleString() for f in p.select("category").schema}
    fields = {"contour_id": kinds["contour_id"], "category": kinds["category"], "similarity": "double", "match": "double", "n_candidates": "bigint", "n_warped": "bigint"}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "double": pa.float64()}
    types = [arrow[k] for k in fields.values()]
    return contours.select("contour_id", "freq").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields.items()))


def predict(contours: DataFrame, prototypes: DataFrame, vigilance: float = 85.0, bias: float = 0.0, w: int = 3, variant: str = "banded", assign_best_only: bool = False) -> DataFrame:
    """contour_id, category (null unless the best prototype's match is above vigilance), match (0.0 without a warp).

    assign_best_only keeps the best category whatever its match. Only the best prototype is tried.
    """
    if prototypes.isEmpty():
        raise RuntimeError("there is no prototype: train first")
    found = nearest(contours, prototypes, bias, w, variant)
    m = F.coalesce("match", F.lit(0.0))
    ok = F.col("match").isNotNull() if assign_best_only else m > vigilance
    return found.select("contour_id", F.when(ok, F.col("category")).alias("category"), m.alias("match"))
