"""Which contours may meet, by counts of lengths, against all pairs."""

import random

from pyspark.sql import functions as F

from undula.functions import kernels
from undula.operators import pairs
from undula.plans import queries


def test_against_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, 2, 3, 4, 5, 8, 9, 26, 27, 28, 80, 81, 300])) for i in range(200)] + [(900, 100_000), (None, 4), (901, 1), (902, 7000), (903, 7000)]
    got = {tuple(r) for r in pairs.near_counts(spark.createDataFrame(rows, "contour_id long, n int")).collect()}
    want = set()
    for a, m in rows:
        near = [n for b, n in rows if None not in (a, b) and a != b and (m == n == 1 or kernels.length_ratio(m, n) < 3)]
        if near:
            want.add((a, len(near), min(near), max(near)))
    assert got == want and 900 not in {r[0] for r in got} and 902 in {r[0] for r in got}
    assert pairs.near_counts(spark.createDataFrame([], "contour_id long, n int")).collect() == []


def test_many_customers_form_no_pairs(spark, tmp_path):
    """40,000 customers of 3 to 7 orders have 1.6 billion pairs; their lengths have 25."""
    n = 40_000
    o = spark.range(n).select(F.col("id").alias("o_custkey"), F.explode(F.sequence(F.lit(0), F.col("id") % 5 + 2)).alias("k"))
    o.select("o_custkey", (F.col("o_custkey") * 10 + F.col("k")).alias("o_orderkey"), F.lit(1.0).alias("o_totalprice"), F.lit("1995-01-01").cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    df = queries.orders_that_may_meet(spark, str(tmp_path))
    assert "o_totalprice" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.n_near, r.shortest, r.longest): r.n for r in df.groupBy("n_near", "shortest", "longest").agg(F.count("*").alias("n")).collect()}
    assert got == {(3 * n // 5 - 1, 3, 5): n // 5, (n - 1, 3, 7): 2 * n // 5, (4 * n // 5 - 1, 4, 7): 2 * n // 5}
