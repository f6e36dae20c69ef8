"""Summaries: the tables behind every figure and report. Each is one or two aggregations; windows without a partition run over counts, not over data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.contours import finite, length_ratio_ok, safe_tempres, valid_weight
from undula.operators import pairs
from undula.operators.ordering import running_sum
from undula.operators.quantiles import quantile


def category_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.filter("category is not null").groupBy("category").agg(F.count("*").alias("n"))


def uncategorised(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count_if(F.col("category").isNull()).alias("n_uncategorised"))


def provenance(named: DataFrame) -> DataFrame:
    """category, names of its members in input order. named: contour_id, name, category."""
    rows = named.filter("category is not null").groupBy("category").agg(F.sort_array(F.collect_list(F.struct("contour_id", "name"))).alias("x"))
    return rows.select("category", F.col("x.name").alias("names"))


def member_rows(named: DataFrame) -> DataFrame:
    """category, pos, contour_id, name: the members of each category in input order, a row each; a category is sorted, never held."""
    at = Window.partitionBy("category").orderBy("contour_id")
    return named.filter("category is not null").select("category", (F.row_number().over(at) - 1).alias("pos"), "contour_id", "name")


def mean_length(assigned: DataFrame, contours: DataFrame) -> DataFrame:
    """category, mean_length, new_length (half to even)."""
    rows = assigned.filter("category is not null").join(contours, "contour_id").groupBy("category").agg(F.avg(F.size("freq")).alias("mean_length"))
    return rows.withColumn("new_length", F.bround("mean_length").cast("int"))


def histogram(values: DataFrame, value: Column, bins: Column | int) -> DataFrame:
    """bin, lo, hi, n of evenly spaced bins over the finite values, the last one closed; equal values span half a unit to each side. bins may depend on n_distinct."""
    x = values.select(value.cast("double").alias("x")).filter(finite(F.col("x")))
    span = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("n_distinct")).filter("lo is not null")
    span = span.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), (bins if isinstance(bins, Column) else F.lit(bins)).cast("int").alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    counts = x.crossJoin(F.broadcast(span)).select(F.least(F.floor((F.col("x") - F.col("lo")) / width), F.col("bins") - 1).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))  # span: one row
    every = span.select("lo", "bins", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def match_histogram(assigned: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(assigned, F.col("match"), bins)


def length_histogram(contours: DataFrame) -> DataFrame:
    return histogram(contours, F.size("freq"), F.least(F.lit(50), F.greatest(F.lit(10), F.col("n_distinct"))))


def tempres_histogram(contours: DataFrame) -> DataFrame:
    rows = contours.filter("tempres > 0").select(F.round("tempres", 6).alias("tempres"))
    return histogram(rows, F.col("tempres"), F.when(F.col("n_distinct") <= 1, 1).otherwise(F.least(F.lit(30), F.greatest(F.lit(3), F.col("n_distinct")))))


def moments(values: DataFrame, value: Column) -> DataFrame:
    """n, mean, median, lo, hi of the finite values."""
    x = values.select(value.cast("double").alias("x")).filter(finite(F.col("x")))
    rest = x.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rest.crossJoin(quantile(x, F.col("x"), name="median")).select("n", "mean", "median", "lo", "hi")  # one row each


def distribution(assigned: DataFrame) -> DataFrame:
    """label, n: categories as text, and Uncategorized."""
    return assigned.groupBy(F.coalesce(F.col("category").cast("string"), F.lit("Uncategorized")).alias("label")).agg(F.count("*").alias("n"))


def stats_table(assigned: DataFrame) -> DataFrame:
    """One row: totals, and mean and median match of the categorised."""
    own = F.when(F.col("category").isNotNull(), F.col("match"))
    rest = assigned.agg(F.count("*").alias("n_contours"), F.count("category").alias("n_categorised"), F.count_if(F.col("category").isNull()).alias("n_uncategorised"), F.count_distinct("category").alias("n_categories"), F.avg(own).alias("mean_match"))
    return rest.crossJoin(quantile(assigned, own, name="median_match"))  # one row each


def match_by_category(assigned: DataFrame) -> DataFrame:
    rows = assigned.filter(F.col("category").isNotNull() & finite(F.col("match")))
    rest = rows.groupBy("category").agg(F.count("*").alias("n"), F.avg("match").alias("mean"), F.min("match").alias("lo"), F.max("match").alias("hi"))
    return rest.join(quantile(rows, F.col("match"), "category", name="median"), "category").select("category", "n", "mean", "median", "lo", "hi")


def vigilance_sweep(runs: DataFrame) -> DataFrame:
    """vigilance, n_categories, mean_match (of all finite matches, the uncategorised ones' too). runs: vigilance, category, match."""
    return runs.groupBy("vigilance").agg(F.count_distinct("category").alias("n_categories"), F.avg(F.when(finite(F.col("match")), F.col("match"))).alias("mean_match"))


def run_stability(meta: DataFrame, assigned: DataFrame) -> DataFrame:
    """counted, bin, lo, hi, n: how many runs have how many categories, by all of a run's prototypes (`all`) and by those with members (`used`).

    meta: run_id, n_categories. assigned: run_id, category.
    """
    used = meta.select("run_id").join(assigned.groupBy("run_id").agg(F.count_distinct("category").alias("n_categories")), "run_id", "left").fillna(0, ["n_categories"])
    bins = F.least(F.lit(20), F.greatest(F.lit(5), F.col("n_distinct")))
    both = [histogram(df, F.col("n_categories"), bins).select(F.lit(name).alias("counted"), "*") for name, df in (("all", meta), ("used", used))]
    return both[0].unionByName(both[1])


def confusion(labelled: DataFrame) -> DataFrame:
    """label, category, n, and the places of both by first appearance. labelled: contour_id, label, category."""
    rows = labelled.filter("category is not null and label is not null")
    n = rows.groupBy("label", "category").agg(F.count("*").alias("n"), F.min("contour_id").alias("first"))
    a, b = (n.groupBy(c).agg(F.min("first").alias("at")) for c in ("label", "category"))
    place = lambda df, name: df.withColumn(name, (F.row_number().over(Window.orderBy("at")) - 1).cast("int")).drop("at")  # noqa: E731  as many rows as labels
    return n.drop("first").join(place(a, "row"), "label").join(place(b, "col"), "category").select("label", "category", "n", "row", "col")


def label_proportion(labelled: DataFrame) -> DataFrame:
    n = labelled.filter("category is not null and label is not null").groupBy("category", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category")))


def resampling_diagnostics(before: DataFrame, after: DataFrame, default: float = 0.01) -> DataFrame:
    """One row on lengths before and after. Both: contour_id, freq; before also tempres."""
    a = before.select("contour_id", F.size("freq").alias("a"), "tempres")
    both = a.join(after.select("contour_id", F.size("freq").alias("b")), "contour_id")
    out = both.agg(
        F.count("*").alias("n"), F.min("a").alias("min_before"), F.max("a").alias("max_before"), F.avg("a").alias("mean_before"), F.min("b").alias("min_after"), F.max("b").alias("max_after"), F.avg("b").alias("mean_after"),
        F.count_if(F.col("b") < F.col("a")).alias("n_down"), F.count_if(F.col("b") > F.col("a")).alias("n_up"), F.count_if(F.col("b") == F.col("a")).alias("n_same"), F.count_if(F.col("tempres") > 0).alias("n_tempres"),
        F.avg(safe_tempres(F.col("tempres"), default)).alias("mean_tempres"),
    )
    return out.withColumn("suggested_cap", F.least(F.lit(600), F.greatest(F.lit(500), F.col("max_before"))))


def before_after(before: DataFrame, after: DataFrame, interval: float, default: float = 0.01) -> DataFrame:
    """contour_id, side (before, after), pos, seconds, value: the points of contours and of the same ones resampled, along time. before also has tempres."""
    points = lambda df, side, step: df.select("contour_id", step.alias("step"), F.posexplode("freq").alias("pos", "value")).select("contour_id", F.lit(side).alias("side"), "pos", (F.col("pos") * F.col("step")).alias("seconds"), "value")
    # resampled points lie evenly over the same time
    size = before.select("contour_id", ((F.size("freq") - 1) * safe_tempres(F.col("tempres"), default)).alias("whole"))
    wide = after.select("contour_id", "freq").join(size, "contour_id")
    step = F.when(F.size("freq") > 1, F.col("whole") / (F.size("freq") - 1)).otherwise(F.lit(interval))
    return points(before, "before", safe_tempres(F.col("tempres"), default)).unionByName(points(wide, "after", step))


def longest(contours: DataFrame, n: int = 3) -> DataFrame:
    return contours.select("contour_id", F.size("freq").alias("length")).orderBy(F.desc("length"), "contour_id").limit(n)


def prediction_summary(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count("category").alias("n_categorised"), F.count_if(F.col("category").isNull()).alias("n_uncategorised"))


def discovery_curve(assigned: DataFrame) -> DataFrame:
    """contour_id, n_seen: how many categories have been seen up to each contour, in input order.

    A category counts at its first contour; the counts are summed over ranges of contours.
    """
    first = assigned.filter("category is not null").groupBy("category").agg(F.min("contour_id").alias("contour_id")).groupBy("contour_id").agg(F.count("*").alias("new"))
    rows = assigned.select("contour_id").join(first, "contour_id", "left")
    return running_sum(rows, "n_seen", F.coalesce("new", F.lit(0)), "contour_id").select("contour_id", F.col("n_seen").cast("int").alias("n_seen"))


def new_per_round(history: DataFrame) -> DataFrame:
    """run_id, iteration, reclassified, added: the signed change of the number of categories."""
    w = Window.partitionBy("run_id").orderBy("iteration")
    return history.select("run_id", "iteration", "reclassified", (F.col("n_categories") - F.lag("n_categories", 1, 0).over(w)).alias("added"))


def members(contours: DataFrame, assigned: DataFrame, category: int, most: int = 20) -> DataFrame:
    """The points of a category's first contours: contour_id, pos, value."""
    own = assigned.filter(F.col("category") == category).orderBy("contour_id").limit(most)
    return contours.join(own.select("contour_id"), "contour_id").select("contour_id", F.posexplode("freq").alias("pos", "value"))


def mds(similarity: DataFrame) -> DataFrame:
    """category, x, y: classical scaling of 100 - similarity (i, j, similarity of all ordered pairs of prototypes; of an asymmetric pair the one below the diagonal)."""
    rows = similarity.collect()  # prototypes x prototypes
    names = sorted({r.i for r in rows})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        d[names.index(r.i), names.index(r.j)] = 100 - r.similarity
    h = np.eye(len(names)) - 1 / max(1, len(names))
    w, v = np.linalg.eigh(-0.5 * h @ (d**2) @ h)
    top = np.argsort(-w)[:2]
    xy = v[:, top] * np.sqrt(np.maximum(w[top], 0))
    xy = np.pad(xy, ((0, 0), (0, 2 - xy.shape[1])))
    return similarity.sparkSession.createDataFrame([(int(c), float(x), float(y)) for c, (x, y) in zip(names, xy, strict=True)], "category int, x double, y double")


def dendrogram(similarity: DataFrame) -> DataFrame:
    """step, a, b, height, size: average linkage of 100 - similarity (i < j); clusters made are numbered on from the prototypes. colour_cut: 0.7 of the top."""
    rows = similarity.filter("i < j").collect()  # prototypes x prototypes
    names = sorted({x for r in rows for x in (r.i, r.j)})
    n = len(names)
    d = {(names.index(r.i), names.index(r.j)): 100 - r.similarity for r in rows}
    size, live, out = dict.fromkeys(range(n), 1), set(range(n)), []
    for step in range(max(0, n - 1)):
        (a, b), height = min(((p, x) for p, x in d.items() if p[0] in live and p[1] in live), key=lambda x: (x[1], x[0]))
        new = n + step
        live -= {a, b}
        for c in live:
            d[(c, new)] = (size[a] * d[min(a, c), max(a, c)] + size[b] * d[min(b, c), max(b, c)]) / (size[a] + size[b])
        live.add(new)
        size[new] = size[a] + size[b]
        out.append((step, a, b, float(height), size[new]))
    cut = 0.7 * max((x[3] for x in out), default=0.0)
    return similarity.sparkSession.createDataFrame([(*x, cut) for x in out], "step int, a int, b int, height double, size int, colour_cut double")


def alignment(contours: DataFrame, named: DataFrame, prototypes: DataFrame, w: int = 3, most: int = 20) -> DataFrame:
    """category, contour_id, i, j, similarity: the warp of each category's first members onto its prototype; a row for each prototype point."""
    first = member_rows(named).filter(F.col("pos") < most).select("category", "contour_id")
    both = first.join(contours.select("contour_id", "freq"), "contour_id").join(prototypes.select("category", valid_weight(F.col("weight")).alias("weight")), "category")
    both = both.filter(length_ratio_ok(F.size("weight"), F.size("freq"), w))
    return pairs.path_rows(pairs.with_warp(both, "weight", "freq", w), "category", "contour_id")


def bands(contours: DataFrame, prototypes: DataFrame, w: int = 3) -> DataFrame:
    """m, n, i, j_lo, j_hi: the columns that each row may use, for every pair of a prototype's and a contour's length that occurs and allows a warp."""
    m = prototypes.select(F.size(valid_weight(F.col("weight"))).alias("m")).distinct()
    n = contours.select(F.size("freq").alias("n")).distinct()
    sizes = pairs.every_pair(n, m, True).filter(length_ratio_ok(F.col("m"), F.col("n"), w))  # different lengths of prototypes, of which there are max_categories
    i, m, n = F.col("i"), F.col("m"), F.col("n")
    lo = F.greatest(F.lit(0), F.floor((i + 1) / w) - 1, (i - m) * w + n)
    hi = F.least(w * (i + 1), F.bround((i - m) / w + n)) - 1
    rows = sizes.select("m", "n", F.explode(F.sequence(F.lit(0), m - 1)).alias("i"))
    return rows.select("m", "n", "i", lo.cast("int").alias("j_lo"), F.least(hi, n - 1).cast("int").alias("j_hi"))


def report(contours: DataFrame, named: DataFrame, similarity: DataFrame | None = None, prototypes: DataFrame | None = None, history: DataFrame | None = None, labels: DataFrame | None = None, raw: DataFrame | None = None, w: int = 3) -> dict[str, DataFrame]:
    """Every table of the results report, by name. named: contour_id, name, category, match. labels: contour_id, label. raw: the contours before resampling, with tempres."""
    out = {
        "category_distribution": distribution(named), "category_sizes": category_sizes(named), "training_stats": stats_table(named), "match_histogram": match_histogram(named), "match_by_category": match_by_category(named),
        "match_moments": moments(named, F.col("match")), "discovery_curve": discovery_curve(named), "members": member_rows(named), "length_histogram": length_histogram(contours), "mean_length": mean_length(named, contours), "longest": longest(contours),
    }
    if "tempres" in contours.columns:
        out["tempres_histogram"] = tempres_histogram(contours)
    if similarity is not None:
        out |= {"similarity": similarity, "embedding": mds(similarity), "dendrogram": dendrogram(similarity)}
    if prototypes is not None:
        out |= {"references": prototypes.select("category", F.posexplode("weight").alias("pos", "value")), "alignment": alignment(contours, named, prototypes, w), "bands": bands(contours, prototypes, w)}
    if history is not None:
        out["convergence"] = new_per_round(history)
    if labels is not None:
        both = named.join(labels.select("contour_id", "label"), "contour_id")
        out |= {"confusion": confusion(both), "label_proportion": label_proportion(both)}
    if raw is not None:
        out |= {"before_after": before_after(raw, contours, 0.01), "resampling": resampling_diagnostics(raw, contours)}
    return out
