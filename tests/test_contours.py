"""Column expressions, training, agreement, files and registered queries."""

import itertools
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula.functions import contours as fc
from undula.functions import kernels
from undula.operators import agreement, art, pairs, predict, summaries, weights
from undula.plans import queries
from undula.sources import files, mat5, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"create view {p[:-8]} as select * from '{SF}/{p}'")
    return c


def rows_of(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if pd.isna(x) else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        assert rows_of(got) == rows_of(duck.execute(queries.ORACLES[name]).df())
    else:
        assert len(got)


def test_expressions_equal_kernels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.uniform(1, 9, n).tolist(), np.sort(rng.integers(0, n, n)).astype(int).tolist()) for i, n in enumerate((1, 2, 3, 7, 20))]
    df = spark.createDataFrame(rows, "i int, freq array<double>, warp array<int>")
    got = df.select("i", fc.resample(F.col("freq"), F.lit(1.0), F.lit(0.7)).alias("r"), fc.cap_length(F.col("freq"), 3).alias("c"), fc.unwarp(F.col("warp")).alias("u")).collect()
    for (_, freq, warp), g in zip(rows, sorted(got), strict=True):
        assert g.r == pytest.approx(kernels.resample(freq, 1.0, 0.7).tolist())
        assert g.c == pytest.approx(kernels.cap(freq, 3).tolist())
        assert g.u == kernels.unwarp(warp).tolist()


def test_faults(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0, [1.0]), (1, []), (2, [1.0, nan]), (3, [inf]), (4, [0.0]), (5, None)], "i int, f array<double>")
    assert [r[0] for r in df.orderBy("i").select(fc.first_fault(F.col("f"))).collect()] == [None, "empty", "nan", "infinite", "not_positive", "missing"]


@pytest.mark.parametrize("bad", [{"vigilance": 0}, {"learning_rate": 0}, {"bias": 2}, {"max_categories": 0}, {"max_iterations": 1.5}, {"warp_factor_level": 1}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        art.Params(**bad)


def test_training(spark):
    three = [[100.0, 200.0, 300.0], [105.0, 205.0, 305.0], [500.0, 600.0, 700.0]]
    f = art.Fold(three, art.Params(vigilance=90, seed=1)).fit()
    assert f.converged and f.category[0] != f.category[2] and len(f.weights) >= 2
    same = art.Fold([three[0]] * 5, art.Params(seed=1)).fit()
    assert len(same.weights) == 1 and (same.match > 99).all()
    assert len(art.Fold([[100.0 * k, 200.0, 50.0 * k] for k in range(1, 20)], art.Params(vigilance=99, max_categories=5, seed=2)).fit().weights) <= 5
    with pytest.raises(ValueError):
        art.Fold([], art.Params())
    for flag in ("purge_empty", "recat_single", "compare_warped", "deprioritize_lone"):
        g = art.Fold(three * 3, art.Params(vigilance=90, seed=3, max_iterations=5, **{flag: True})).fit()
        assert set(g.category) <= set(range(-1, len(g.weights)))
    df = spark.createDataFrame(list(enumerate(three)), "contour_id long, freq array<double>")
    r = art.fit(df, {"a": art.Params(vigilance=90, seed=1), "b": art.Params(vigilance=90, seed=1)}).cache()
    a = art.assignments(r).toPandas().sort_values(["run_id", "contour_id"])
    assert a[a.run_id == "a"].category.tolist() == a[a.run_id == "b"].category.tolist() == f.category.tolist()
    assert art.meta(r).filter("converged").count() == 2
    p = art.prototypes(r).filter("run_id = 'a'").select("category", "weight")
    near = predict.predict(df, p, 90.0).toPandas().sort_values("contour_id")
    assert near.category.tolist() == f.category.tolist()
    assert predict.predict(spark.createDataFrame([(9, [1.0, 9000.0, 1.0])], df.schema), p, 90.0).first().category is None
    with pytest.raises(RuntimeError):
        predict.predict(df, weights.empty(spark))


def test_prototype_tables(spark):
    p = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0]), (2, [5.0, 6.0])], "category int, weight array<double>")
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, None)], "contour_id long, category int")
    kept, again, gone = weights.purge(p, a)
    assert gone == 1 and [r.category for r in again.orderBy("contour_id").collect()] == [0, 0, 1, None] and kept.count() == 2
    q, b = weights.delete_reindex(p, a, 1)
    assert sorted(r.category for r in q.collect()) == [0, 1] and [r.category for r in b.orderBy("contour_id").collect()] == [0, 0, 1, None]
    with pytest.raises(IndexError):
        weights.delete(p, 3)
    with pytest.raises(ValueError):
        weights.delete_reindex(p, a, 0)
    c = spark.createDataFrame([(i, [1.0] * n) for i, n in enumerate((4, 6, 2, 1))], "contour_id long, freq array<double>")
    assert {r.category: len(r.weight) for r in weights.average(p, c, a).collect()} == {0: 5, 1: 1, 2: 2}
    assert weights.active(p) == 3 and weights.add(p, [7.0]).count() == 4 and weights.long_form(p).count() == 9
    assert pairs.prototype_pairs(p).count() == 9 and pairs.prototype_pairs(p, ordered=False).count() == 3


def test_assignment_problem():
    rng = np.random.default_rng(2)
    for _ in range(100):
        r, c = map(int, rng.integers(1, 6, 2))
        g = rng.integers(0, 9, (r, c)).astype(float)
        g = g if r <= c else g.T
        best = max(sum(g[i, p[i]] for i in range(g.shape[0])) for p in itertools.permutations(range(g.shape[1]), g.shape[0]))
        assert sum(g[i, j] for i, j in agreement.assignment_problem(g)) == best
        assert sum(g.T[i, j] for i, j in agreement.assignment_problem(g.T)) == best


def test_agreement_ignores_names(spark):
    a = [(i, i % 3, (i % 3 + 1) % 3) for i in range(30)]
    s = agreement.scores(spark.createDataFrame(a, "i int, x int, y int"), "x", "y").first()
    assert s.ari == pytest.approx(1) and s.nmi == pytest.approx(1) and s.purity == 1 and s.left_only == s.right_only == 0
    assert agreement.best_match_accuracy(spark.createDataFrame(a, "i int, x int, y int"), "x", "y").first().accuracy == 1
    one = agreement.scores(spark.createDataFrame([(1, 1), (1, 1)], "x int, y int"), "x", "y").first()
    assert one.ari == 1 and one.nmi == 1


def test_files(spark, tmp_path):
    d = tmp_path / "c"
    d.mkdir()
    (d / "b.csv").write_text("Time [ms],Peak Frequency [Hz]\n0,100\n5,110\n10,120\n")
    (d / "a.csv").write_text("header\n100.0\n200.0\n300.0\n")
    (d / "t.txt").write_text("100.0\t0\n200.0\t0\n300.0\t0\n")
    (d / "bad.csv").write_text("x\nword\n")
    (d / "f.ctr").write_bytes(mat5.write({"fcontour": [100, 200, 300], "tempres": 0.01, "id": "abc", "parent_ids": ["p", " ", "q"]}, compress=True))
    (d / "g.ctr").write_bytes(mat5.write({"freqContour": [100, 200, 300, 400], "tempres": 0.01, "ctrlength": 0.02}))
    good, failed = files.load_contours(spark, f"file://{d}")
    rows = {r.name: r for r in good.collect()}
    assert [r.name for r in sorted(rows.values(), key=lambda r: r.contour_id)] == ["f", "g", "a", "b", "t"]
    assert rows["a"].freq == [100, 200, 300] and rows["a"].tempres is None and rows["b"].tempres == pytest.approx(0.005)
    assert rows["t"].freq == [100, 200] and rows["t"].tempres == pytest.approx(0.1)
    assert rows["f"].ctrlength == pytest.approx(0.03) and rows["f"].parent_ids == ["p", "q"] and rows["g"].freq == [100, 200, 300] and rows["g"].ctrlength == 0.02
    assert failed.count() == 1
    for path, kind, error in ((tmp_path / "none", "auto", FileNotFoundError), (d / "a.csv", "auto", NotADirectoryError), (d, "wav", ValueError)):
        with pytest.raises(error):
            files.load_contours(spark, f"file://{path}", kind)


def test_saved_categorisation(spark, tmp_path):
    nan = float("nan")
    path = tmp_path / "net.mat"
    path.write_bytes(mat5.write({"NET": {"weight": np.array([[1.0, 4.0], [2.0, 5.0], [nan, 6.0]]), "vigilance": 90.0}, "DATA": [{"name": "a", "contour": [1, 2], "category": 1.0, "match": 0.95}, {"name": "b", "contour": [3], "category": nan, "match": nan}]}))
    params, prototypes, rows = files.load_categorisation(spark, f"file://{path}")
    assert params["vigilance"] == 90 and params["max_categories"] == 50 and params["n_categories"] == 2 and prototypes.count() == 2
    got = rows.orderBy("contour_id").collect()
    assert [r.category for r in got] == [0, None] and got[1].match is None
    assert sinks.categorisation_rows(rows).filter("contour_name = 'a'").first().match == 95.0
    assert sinks.wide_prototypes(weights.long_form(prototypes), 2).columns == ["pos", "cat_1", "cat_2"]
    with pytest.raises(ValueError):
        files.read_categorisation(mat5.write({"X": [1.0]}))


def test_exports(spark, tmp_path):
    p = spark.createDataFrame([(0, [12.25, float("nan")]), (1, [float("nan")])], "category int, weight array<double>")
    assert sinks.export_prototypes(p, f"file://{tmp_path}/p") == 1
    assert (tmp_path / "p/refContour_1.csv").read_text() == "   12.2\n"
    named = spark.createDataFrame([("a", 0, 95.12345), ("b", None, 1.0)], "name string, category int, match double")
    assert [tuple(r) for r in sinks.assignment_rows(named, True).orderBy("contour_name").collect()] == [("a", "1", "95.123"), ("b", "uncategorized", "1.000")]
    prov = summaries.provenance(spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "c", 1)], "contour_id long, name string, category int"))
    rows = sinks.provenance_rows(prov).toPandas()
    assert len(rows) == 3 and rows.groupby("category").ref_contour_id.nunique().tolist() == [1, 1]
    sinks.save_model({"prototypes": p}, f"file://{tmp_path}/m")
    assert sinks.load_model(spark, f"file://{tmp_path}/m")["prototypes"].count() == 2


def test_report(spark):
    c = spark.createDataFrame([(i, [float(i + 1)] * (i % 3 + 1), 0.01) for i in range(9)], "contour_id long, freq array<double>, tempres double")
    named = spark.createDataFrame([(i, f"n{i}", None if i == 4 else i % 2, 90.0 + i) for i in range(9)], "contour_id long, name string, category int, match double")
    sim = spark.createDataFrame([(i, j, 100.0 if i == j else 50.0 + i) for i in range(3) for j in range(3)], "i int, j int, similarity double")
    tables = summaries.report(c, named, sim)
    assert all(t.count() for t in tables.values())
    assert tables["training_stats"].first().n_uncategorised == 1
    assert sum(r.n for r in tables["match_histogram"].collect()) == 9


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/undula", tmp_path / "undula", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(queries.QUERIES)), str(len(queries.ORACLES)), "False"]


@pytest.mark.parametrize("flags", [{}, {"purge_empty": True, "compare_warped": True}, {"recat_single": True, "deprioritize_lone": True}])
def test_remembered_comparisons_change_nothing(flags, monkeypatch):
    rnd = np.random.default_rng(5)
    base = [rnd.random(n) * 200 + 50 for n in (8, 12, 20, 24)]
    contours = [base[i % 4] * (1 + rnd.normal(0, 0.06, len(base[i % 4]))) for i in range(36)]
    p = art.Params(vigilance=92, seed=4, max_categories=12, max_iterations=8, **flags)
    a = art.Fold(contours, p).fit()
    monkeypatch.setattr(art, "REMEMBERED", 0)
    b = art.Fold(contours, p).fit()
    assert a.history == b.history and (a.category == b.category).all() and (a.match == b.match).all()
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights, strict=True)) and a.points > 0 == b.points
