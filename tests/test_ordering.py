"""Numbers and running sums over ranges against one window over everything."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from undula.operators import ordering


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(997).select(((F.col("id") * 7919) % 997).alias("k"), (F.col("id") % 5).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") % 3).alias("v")).repartition(5)


def test_numbered(spark, rows):
    got = ordering.numbered(rows, "n", F.desc("g"), F.asc("k"), start=1)
    want = rows.withColumn("n", F.row_number().over(Window.orderBy(F.desc("g"), F.asc("k"))).cast("long"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert "Window" not in plan_of(ordering._dealt(rows, ("k",), 4))


def test_numbered_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, "a"), (0, "c")], "k int, x string")
    got = ordering.numbered(df, "n", "k", parts=3)
    assert sorted(r.n for r in got.collect()) == [0, 1, 2, 3, 4]
    assert {r.n for r in got.collect() if r.k is None} == {0, 1}
    assert ordering.numbered(df.limit(0), "n", "k").collect() == []


def test_running_sum(spark, rows):
    got = ordering.running_sum(rows, "s", F.coalesce("v", F.lit(0)), "k", parts=7)
    want = rows.withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(Window.orderBy("k")))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert ordering.running_sum(rows.limit(0), "s", F.col("v"), "k").collect() == []


def test_a_cluster_must_name_a_shared_folder():
    from undula import storage

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://elsewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
