"""Agreement of two labelings, all from one contingency table; only that table (labels x labels) is ever joined with its margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.contours import strip_extension


def contingency(labels: DataFrame, left: str, right: str) -> DataFrame:
    """a, b, n with the margins n_a, n_b of rows that have both labels."""
    n = labels.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("a"), F.col(right).alias("b")).agg(F.count("*").alias("n"))
    a, b = n.groupBy("a").agg(F.sum("n").alias("n_a")), n.groupBy("b").agg(F.sum("n").alias("n_b"))
    return n.join(a, "a").join(b, "b")


def _two(x):
    return x * (x - 1) / 2


def scores(labels: DataFrame, left: str, right: str) -> DataFrame:
    """One row: n, ari, nmi, fowlkes_mallows, homogeneity, completeness, v_measure (truth left, prediction right), purity, and the pair counts."""
    t = contingency(labels, left, right)
    a = t.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_two(F.col("n"))).alias("pairs_a"), F.sum(F.col("n")).alias("total"), F.sum(F.col("n") * F.log("n")).alias("log_a"))
    b = t.groupBy("b").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(F.sum(_two(F.col("n"))).alias("pairs_b"), F.sum(F.col("n") * F.log("n")).alias("log_b"), F.sum("most").alias("pure"))
    both = t.agg(F.sum(_two(F.col("n"))).alias("same"), F.sum(F.col("n") * F.log("n")).alias("log_ab"))
    x = a.crossJoin(b).crossJoin(both)  # one row each
    n = F.col("total").cast("double")
    h_a, h_b = F.log(n) - F.col("log_a") / n, F.log(n) - F.col("log_b") / n
    mutual = F.col("log_ab") / n - F.col("log_a") / n - F.col("log_b") / n + F.log(n)
    x = x.withColumns({"h_a": h_a, "h_b": h_b, "mutual": mutual, "all_pairs": _two(n)})
    tiny = 1e-12
    expected = F.col("pairs_a") * F.col("pairs_b") / F.when(F.col("all_pairs") > 0, F.col("all_pairs"))
    top = (F.col("pairs_a") + F.col("pairs_b")) / 2 - expected
    x = x.withColumns({
        "ari": F.when(F.abs(top) > tiny, (F.col("same") - expected) / top).otherwise(1.0),
        "nmi": F.when(F.col("h_a") + F.col("h_b") > tiny, F.col("mutual") / ((F.col("h_a") + F.col("h_b")) / 2)).otherwise(1.0),
        "fowlkes_mallows": F.when(F.col("same") > 0, F.col("same") / F.sqrt(F.col("pairs_a") * F.col("pairs_b"))).otherwise(0.0),
        "homogeneity": F.when(F.col("h_a") > tiny, F.col("mutual") / F.col("h_a")).otherwise(1.0),
        "completeness": F.when(F.col("h_b") > tiny, F.col("mutual") / F.col("h_b")).otherwise(1.0),
        "purity": F.col("pure") / n,
    })
    hc = F.col("homogeneity") + F.col("completeness")
    return x.select(
        F.col("total").alias("n"), "ari", "nmi", "fowlkes_mallows", "homogeneity", "completeness", F.when(hc > tiny, 2 * F.col("homogeneity") * F.col("completeness") / hc).otherwise(0.0).alias("v_measure"), "purity",
        F.col("same").cast("long").alias("both_same"), (F.col("pairs_a") - F.col("same")).cast("long").alias("left_only"), (F.col("pairs_b") - F.col("same")).cast("long").alias("right_only"),
        (F.col("all_pairs") - F.col("pairs_a") - F.col("pairs_b") + F.col("same")).cast("long").alias("both_different"),
    )


def verdict(ari):
    """What an adjusted Rand index says."""
    return F.when(ari >= 0.8, "excellent").when(ari >= 0.6, "good").when(ari >= 0.4, "moderate").when(ari >= 0.2, "weak").otherwise("poor")


def category_purity(labels: DataFrame, truth: str, category: str) -> DataFrame:
    """category, size, dominant (most frequent label, ties by the smallest), n_labels, purity."""
    n = labels.filter(F.col(truth).isNotNull() & F.col(category).isNotNull()).groupBy(F.col(category).alias("category"), F.col(truth).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "label")
    size = Window.partitionBy("category")
    out = n.withColumns({"at": F.row_number().over(w), "size": F.sum("n").over(size), "n_labels": F.count("*").over(size)}).filter("at = 1")
    return out.select("category", "size", F.col("label").alias("dominant"), "n_labels", (F.col("n") / F.col("size")).alias("purity"))


def most_impure(purity: DataFrame, n: int = 20) -> DataFrame:
    return purity.orderBy("purity", "category").limit(n)


def assignment_problem(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total, each row and column once at most; shortest augmenting paths with potentials."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    rows, cols = cost.shape
    u, v, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for r in range(rows):
        dist, back, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, dtype=bool)
        row, col, base = r, -1, 0.0
        while True:
            reach = base + cost[row] - u[row] - v
            better = ~done & (reach < dist - 1e-12)
            dist[better], back[better] = reach[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        on = done.copy()
        on[col] = False
        u[r] += base
        u[owner[on]] += base - dist[on]
        v[done] -= base - dist[done]
        while col >= 0:
            before = back[col]
            owner[col] = r if before < 0 else owner[before]
            col = before
    pairs = [(int(owner[c]), c) for c in range(cols) if owner[c] >= 0]
    return [(c, r) for r, c in pairs] if flip else pairs


def best_match_accuracy(labels: DataFrame, left: str, right: str) -> DataFrame:
    """accuracy: the share of rows on which the labelings agree under the best one-to-one naming. Only the contingency table goes to the driver."""
    rows = contingency(labels, left, right).select("a", "b", "n").collect()
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    table = np.zeros((len(a), len(b)))
    for r in rows:
        table[a.index(r.a), b.index(r.b)] = r.n
    hit = sum(table[i, j] for i, j in assignment_problem(table)) if rows else 0.0
    return labels.sparkSession.createDataFrame([(float(hit / table.sum()) if rows else 0.0, int(hit))], "accuracy double, n_agreeing long")


def shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of two categorisations (contour_name, category, match) whose names agree without extension; matches of more than 200 are in hundredths of a per cent."""
    def ready(df: DataFrame, suffix: str) -> DataFrame:
        top = df.agg(F.max("match").alias("top"))  # one row
        m = F.when(F.col("top") > 200, F.col("match") / 100).otherwise(F.col("match"))
        return df.crossJoin(F.broadcast(top)).select(strip_extension(F.col("contour_name")).alias("contour_name"), F.col("category").alias(f"category_{suffix}"), m.alias(f"match_{suffix}"))

    return ready(left, "left").join(ready(right, "right"), "contour_name")


def sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n_left, n_right, n_shared (pairs of rows whose names agree), left_only and right_only (rows less shared; repeated names can make them negative), n_left_names_only and n_right_names_only (names
    that the other side doesn't have). Names are compared without extension; each side is counted by name before the join."""
    def named(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(strip_extension(F.col("contour_name")).alias("name")).agg(F.count("*").alias(n))

    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    both = named(left, "a").join(named(right, "b"), "name", "full")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    out = both.agg(total(a, "n_left"), total(b, "n_right"), total(a * b, "n_shared"), F.count_if(b == 0).alias("n_left_names_only"), F.count_if(a == 0).alias("n_right_names_only"))
    return out.select("n_left", "n_right", "n_shared", (F.col("n_left") - F.col("n_shared")).alias("left_only"), (F.col("n_right") - F.col("n_shared")).alias("right_only"), "n_left_names_only", "n_right_names_only")


def overview(joined: DataFrame) -> DataFrame:
    """One row for each side of shared(): n_categories, mean_match, mean_size, singletons."""
    out = None
    for side in ("left", "right"):
        sizes = joined.filter(F.col(f"category_{side}").isNotNull()).groupBy(f"category_{side}").agg(F.count("*").alias("n"), F.sum(f"match_{side}").alias("m"), F.count(f"match_{side}").alias("k"))
        row = sizes.agg(F.lit(side).alias("side"), F.count("*").alias("n_categories"), (F.sum("m") / F.sum("k")).alias("mean_match"), F.avg("n").alias("mean_size"), F.count_if(F.col("n") == 1).alias("singletons"))
        out = row if out is None else out.unionByName(row)
    return out
