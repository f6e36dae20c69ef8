"""Joins on lengths and the bound-pruned search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import kernels
from undula.functions.contours import length_ratio_ok
from undula.operators import pairs, predict
from undula.plans import queries

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def ragged(spark):
    rng = np.random.default_rng(5)
    sizes = [0, 1, 1, 2, 2, 3, 4, 5, 8, 9, 10, 26, 27, 28, 29, 80, 81, 82, 243]
    rows = [(i, (rng.uniform(1, 9, n) * 10 ** rng.uniform(0, 2)).tolist()) for i, n in enumerate(sizes * 2)] + [(99, None)]
    return spark.createDataFrame(rows, "contour_id long, freq array<double>").repartition(3)


@pytest.mark.parametrize("w", [2, 3, 5])
@pytest.mark.parametrize("few", [True, False])
def test_length_join(spark, ragged, monkeypatch, w, few):
    if not few:
        monkeypatch.setattr(pairs, "FEW", 1)
    other = ragged.select(F.col("contour_id").alias("category"), F.col("freq").alias("weight"))
    got = pairs.length_join(ragged, other, "freq", "weight", w)
    want = ragged.join(other, length_ratio_ok(F.size("freq"), F.size("weight"), w))
    assert sorted((r.contour_id, r.category) for r in got.collect()) == sorted((r.contour_id, r.category) for r in want.collect())
    plan = plan_of(got)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and (not few or "BroadcastHashJoin" in plan)  # Spark may broadcast a small side by itself


def test_many_prototypes_make_no_product(spark, ragged, monkeypatch):
    p = ragged.select((F.col("contour_id") * 2).cast("int").alias("category"), F.col("freq").alias("weight"))
    few = [sorted(map(tuple, df.collect())) for df in (pairs.compare(ragged, p).select("contour_id", "category", "similarity"), pairs.prototype_pairs(p), pairs.prototype_pairs(p, ordered=False))]
    monkeypatch.setattr(pairs, "FEW", 1)
    many = (pairs.compare(ragged, p).select("contour_id", "category", "similarity"), pairs.prototype_pairs(p), pairs.prototype_pairs(p, ordered=False))
    for a, df in zip(few, many, strict=True):
        assert a == sorted(map(tuple, df.collect()))
        assert "CartesianProduct" not in plan_of(df) and "NestedLoop" not in plan_of(df)
    assert len(few[1]) == 39 * 39


@pytest.mark.parametrize("variant", ["banded", "short_diagonal"])
@pytest.mark.parametrize("w", [2, 3, 4])
def test_bounds_are_never_too_low(variant, w):
    rng = np.random.default_rng(w)
    for _ in range(60):
        refs = [rng.uniform(0.1, 9, rng.integers(1, 30)) for _ in range(12)]
        x = rng.uniform(0, 9, rng.integers(1, 30)) * (rng.random() > 0.2)
        own, bound = kernels.Bounds(refs, w, variant).of(x)
        assert own.tolist() == [k for k, r in enumerate(refs) if len(r) == len(x) == 1 or kernels.length_ratio(len(r), len(x)) < w]
        for k, b in zip(own, bound, strict=True):
            assert b >= kernels.dtw(refs[k], x, w, variant)[0] * (1 - 1e-12)


@pytest.mark.parametrize("gain", [1.0, 0.7, 0.0])
def test_nearest_is_the_best_of_all(gain):
    rng = np.random.default_rng(8)
    refs = [rng.uniform(1, 9, rng.integers(1, 25)) * 10 ** rng.uniform(0, 2) for _ in range(40)]
    refs[7] = refs[30] = refs[12]
    inputs = [rng.uniform(1, 9, rng.integers(0, 25)) * 10 ** rng.uniform(0, 2) for _ in range(60)] + [refs[12], np.array([1.0, np.nan, 3.0]), np.array([-1.0, 2.0, 5.0, 4.0])]
    pairs_, warped = 0, 0
    for x, got in zip(inputs, kernels.nearest(inputs, kernels.Bounds(refs), gain), strict=True):
        every = [(gain * s, -k, s) for k, r in enumerate(refs) for s, path in [kernels.dtw(r, x)] if len(path)]
        if not every:
            assert got is None
            continue
        if not np.isnan(x).any():
            assert (got[0], got[1]) == (-max(every)[1], pytest.approx(max(every)[2]))
        assert got[3] == len(every) and 1 <= got[4] <= got[3]
        pairs_, warped = pairs_ + got[3], warped + got[4]
    assert warped < 0.5 * pairs_ or not gain


def test_search_gives_the_rows_of_all_pairs(spark, monkeypatch):
    contours, p = queries.orders(spark, SF), queries.national(spark, SF)
    fast = predict.nearest(contours, p, bias=0.1)
    assert "Exchange" not in plan_of(predict.nearest(contours.select("contour_id", "freq"), p)).split("MapInArrow")[0]
    rows = fast.collect()
    monkeypatch.setattr(pairs, "FEW", 0)
    slow = predict.nearest(contours, p, bias=0.1).collect()
    key = lambda r: (r.contour_id, r.category, None if r.match is None else round(r.match, 8), r.n_candidates)
    assert sorted(map(key, rows), key=str) == sorted(map(key, slow), key=str)
    assert sum(r.n_warped for r in rows) < 0.8 * sum(r.n_candidates for r in rows)


def test_prediction_is_the_same_either_way(spark, monkeypatch):
    contours, p = queries.events(spark, SF), queries.national(spark, SF).withColumn("weight", F.transform("weight", lambda x: x / 1000))
    for more in ({"bias": 0.2}, {"assign_best_only": True}, {"w": 5, "variant": "short_diagonal"}):
        monkeypatch.setattr(pairs, "FEW", 20_000)
        a = predict.predict(contours, p, 40.0, **more).collect()
        monkeypatch.setattr(pairs, "FEW", 0)
        b = predict.predict(contours, p, 40.0, **more).collect()
        key = lambda r: (r.contour_id, r.category, round(r.match, 8))
        assert sorted(map(key, a), key=str) == sorted(map(key, b), key=str)
