"""Similarities without warps against the warps' own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import kernels
from undula.operators import pairs


@pytest.mark.parametrize("w", [2, 3, 5])
def test_equal_to_warps(w):
    rng = np.random.default_rng(w)
    for m, n in [(1, 1), (1, 2), (2, 2), (2, 3), (3, 7), (7, 3), (5, 5), (9, 20), (20, 9), (31, 14), (14, 31), (40, 40)]:
        refs, inputs = rng.integers(0, 5, (4, m)).astype(float), rng.integers(0, 5, (6, n)).astype(float)
        inputs[5, n // 2] = np.nan
        got = kernels.scores(refs, inputs, w)
        with np.errstate(all="ignore"):
            want = [[kernels.dtw(r, x, w)[0] for x in inputs] for r in refs]
        np.testing.assert_array_equal(got, np.array(want))
    with pytest.raises(ValueError):
        kernels.scores(np.ones((1, 9000)), np.ones((1, 9000)))


@pytest.mark.parametrize("few", [True, False])
def test_frames(spark, few, monkeypatch):
    monkeypatch.setattr(pairs, "FEW", 20_000 if few else 0)
    monkeypatch.setattr(pairs, "_CELLS", 40)
    rng = np.random.default_rng(1)
    contours = spark.createDataFrame([(i, rng.uniform(1, 9, int(n)).tolist()) for i, n in enumerate(rng.integers(1, 14, 60))] + [(90, []), (91, None)], "contour_id long, freq array<double>").repartition(3)
    protos = spark.createDataFrame([(f"p{i}", rng.uniform(1, 9, int(n)).tolist()) for i, n in enumerate(rng.integers(1, 14, 9))] + [("x", None), ("y", []), ("z", [0.0, 3.0, float("nan"), 4.0])], "category string, weight array<double>")
    got = {tuple(r) for r in pairs.similarities(contours, protos, 3, bias=0.2).collect()}
    want = {tuple(r) for r in pairs.compare(contours, protos, 3, bias=0.2).select("contour_id", "category", "similarity", "activation").collect()}
    assert got == want and len(got) > 100


def test_warps_do_not_travel(spark):
    c = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "contour_id long, freq array<double>")
    df = pairs.similarities(c, c.select(F.col("contour_id").alias("category"), F.col("freq").alias("weight")))
    assert df.columns == ["contour_id", "category", "similarity", "activation"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "warp" not in plan and "Join" not in plan
