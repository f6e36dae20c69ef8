"""The registered SQL functions against the column expressions and kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import contours as fc
from undula.functions import kernels, sql
from undula.sources import mat5


@pytest.fixture(scope="module")
def rows(spark):
    sql.register(spark)
    assert set(sql.register(spark)) == set(sql.SQL) | {"dtw", "update_weights", "write_ctr", "read_ctr", "read_contour"}
    rng = np.random.default_rng(7)
    nan, inf = float("nan"), float("inf")
    out = [(i, rng.uniform(1, 9, n).tolist(), rng.uniform(1, 9, m).tolist(), np.sort(rng.integers(0, n, m)).astype(int).tolist(), 0.01 * (i % 3 - 1)) for i, (n, m) in enumerate([(1, 1), (2, 2), (2, 7), (3, 6), (7, 9), (20, 20), (31, 12), (9, 9)])]
    out += [(8, [1.0, 2.0, 3.0], [2.0, nan, 3.0], [0, 0, 2], 0.0), (9, [1.0, 2.0], [0.0, inf], [], None), (10, None, None, None, None)]
    return spark.createDataFrame(out, "i int, a array<double>, b array<double>, w array<int>, t double")


def both(spark, rows, text, column):
    got = {r.i: r.x for r in spark.sql(f"SELECT i, {text} AS x FROM {{rows}} WHERE i < 10", rows=rows).collect()}
    want = {r.i: r.x for r in rows.filter("i < 10").select("i", column.alias("x")).collect()}
    assert repr(got) == repr(want)


def test_expressions(spark, rows):
    a, b, w, t = (F.col(c) for c in "abwt")
    both(spark, rows, "length_ratio_ok(size(a), size(b), 3)", fc.length_ratio_ok(F.size(a), F.size(b), 3))
    both(spark, rows, "valid_weight(b)", fc.valid_weight(b))
    both(spark, rows, "warp_gather(a, w)", fc.gather(a, w))
    both(spark, rows, "unwarp(w)", fc.unwarp(w))
    both(spark, rows, "resample_linear(a, 1.0D, 0.7D)", fc.resample(a, F.lit(1.0), F.lit(0.7)))
    both(spark, rows, "cap_length(a, 3)", fc.cap_length(a, 3))
    both(spark, rows, "cap_length(a, 1)", fc.cap_length(a, 1))
    both(spark, rows, "safe_tempres(t, 0.5D)", fc.safe_tempres(t, 0.5))
    both(spark, rows, "art_match(a, slice(concat(b, a), 1, size(a)))", fc.match(a, F.slice(F.concat(b, a), 1, F.size(a))))
    both(spark, rows, "strip_extension(concat(' ', i, '.CSV'))", fc.strip_extension(F.concat(F.lit(" "), F.col("i"), F.lit(".CSV"))))
    both(spark, rows, "similarity_matrix(a, b)", F.transform(a, lambda x: F.transform(b, lambda y: fc.ratio(x, y))))


def test_sql_functions_stay_in_the_jvm(spark, rows):
    df = spark.sql("SELECT cap_length(resample_linear(a, 1.0D, 0.7D), 5) AS x FROM {rows} WHERE length_ratio_ok(size(a), size(b), 3)", rows=rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dtw(spark, rows):
    for w in (2, 3, 5):
        got = {r.i: (r.x.similarity, r.x.warp) for r in spark.sql(f"SELECT i, dtw(a, b, {w}) AS x FROM {{rows}} WHERE i < 8", rows=rows).collect()}
        for r in rows.filter("i < 8").collect():
            s, warp = kernels.dtw(r.a, r.b, w)
            assert got[r.i] == (s, warp.tolist())
    # lengths as in the pairs that are refused: 2 against 7 at w = 2, 3 against 6 at w = 3
    assert spark.sql("SELECT dtw(array(1D, 2D), array(1D, 1D, 2D, 2D, 3D, 3D, 4D), 2) AS x").first().x == (0.0, [])
    assert spark.sql("SELECT dtw(array(1D, 2D, 3D), array(1D, 1D, 2D, 2D, 3D, 3D), 3) AS x").first().x == (0.0, [])
    assert spark.sql("SELECT dtw(a, b, 3) AS x FROM {rows} WHERE i = 10", rows=rows).first().x is None


def test_update_weights(spark, rows):
    for r in spark.sql("SELECT a, b, x.warp, update_weights(b, a, 0.3D, x.warp) AS new FROM (SELECT a, b, dtw(a, b, 5) AS x FROM {rows} WHERE i < 8) WHERE size(x.warp) > 0", rows=rows).collect():
        assert r.new == pytest.approx(kernels.update(r.b, r.a, 0.3, r.warp).tolist())
    assert spark.sql("SELECT update_weights(a, b, 0.3D, w) AS x FROM {rows} WHERE i = 10", rows=rows).first().x is None


def test_errors(spark):
    for text, says in (("art_match(array(1D), array(1D, 2D))", "differ in length"), ("resample_linear(array(1D, 2D), 0D, 1D)", "positive"), ("cap_length(array(1D, 2D), 0)", "1 or more")):
        with pytest.raises(Exception, match=says):
            spark.sql(f"SELECT {text} AS x").collect()


def test_table_functions(spark):
    ctr = mat5.write({"fcontour": [100, 200, 300], "tempres": 0.01, "id": "abc", "parent_ids": ["p", " ", "q"]}, compress=True)
    df = spark.createDataFrame([("d/a.ctr", ctr), ("d/b.CSV", b"x,Frequency [Hz]\n1,5\n2,6\n"), ("c.txt", b"100.0\t0\n200.0\t0\n300.0\t0\n"), ("e.ctr", b"no"), ("f.wav", b""), (None, None), ("g.csv", None)], "path string, content binary")
    got = {r.name: r for r in spark.sql("SELECT c.* FROM {f} f, LATERAL read_contour(f.path, f.content) c", f=df).collect()}
    assert (got["a"].freq, got["a"].ref_id, got["a"].parent_ids, got["a"].error) == ([100, 200, 300], "abc", ["p", "q"], None)
    assert got["b"].freq == [5, 6] and got["c"].freq == [100, 200] and set(got) == {"a", "b", "c", "e", "f"}
    assert got["e"].error and "unknown format" in got["f"].error
    (row,) = spark.sql("SELECT c.* FROM {f} f, LATERAL read_ctr(f.content) c WHERE f.path = 'd/a.ctr'", f=df).collect()
    assert row.ctrlength == pytest.approx(0.03) and row.error is None
