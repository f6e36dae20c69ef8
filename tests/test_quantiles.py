"""Exact quantiles against numpy, with ranges so small that every pass is used."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import quantiles, summaries


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    groups = {
        0: rng.standard_normal(501), 1: 10 ** rng.uniform(-200, 200, 400), 2: np.repeat([1.0, 2.0, 3.0], [50, 301, 50]), 3: np.array([5.0]), 4: np.array([1.0, 2.0]),
        5: np.full(300, -7.5), 6: np.concatenate([np.zeros(200), rng.uniform(0, 1e-9, 201)]), None: rng.uniform(0, 1, 97),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(0, None), (0, float("nan")), (1, float("inf")), (9, None)]
    return groups, spark.createDataFrame(rows, "g int, v double").repartition(5)


@pytest.mark.parametrize(("q", "most", "pivots"), [(0.5, 10_000, 32), (0.5, 3, 4), (0.0, 5, 2), (1.0, 5, 3), (0.37, 2, 8)])
def test_groups(values, q, most, pivots):
    groups, df = values
    got = {r.g: r.quantile for r in quantiles.quantile(df, F.col("v"), "g", q=q, most=most, pivots=pivots).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(xs, q), rel=1e-12, abs=1e-300)


def test_all(spark, values):
    groups, df = values
    every = np.concatenate(list(groups.values()))
    assert quantiles.quantile(df, F.col("v"), most=7, pivots=6).collect()[0][0] == pytest.approx(np.median(every))
    assert quantiles.quantile(df.filter("g = 9"), F.col("v")).collect()[0][0] is None
    assert quantiles.quantile(df.filter("g = 9"), F.col("v"), "g").collect() == []
    with pytest.raises(ValueError):
        quantiles.quantile(df, F.col("v"), q=1.5)


def test_summaries_hold_no_percentile_buffer(values):
    groups, df = values
    m = summaries.moments(df.filter("g = 0"), F.col("v"))
    assert m.first().median == pytest.approx(np.median(groups[0])) and m.first().n == 501
    named = df.withColumnRenamed("g", "category").withColumnRenamed("v", "match")
    by = summaries.match_by_category(named)
    assert {r.category: r.median for r in by.collect()} == pytest.approx({g: np.median(x) for g, x in groups.items() if g is not None})
    for plan in (m, by, summaries.stats_table(named)):
        assert "percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    empty = summaries.stats_table(named.limit(0)).first()
    assert (empty.n_contours, empty.median_match) == (0, None)
