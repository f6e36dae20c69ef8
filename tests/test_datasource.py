"""The data sources, the extraction of saved categorisations, and stable ids."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions.contours import NAMESPACE, fixed, name_id
from undula.sources import datasource, files, mat5, sinks

NAN = float("nan")


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    datasource.register(spark)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.csv").write_text("Time [ms],Peak Frequency [Hz]\n0,100\n5,110\n10,120\n")
    (tmp_path / "a.csv").write_text("header\n100.0\n200.0\n300.0\n")
    (tmp_path / "t.txt").write_text("100.0\t0\n200.0\t0\n300.0\t0\n")
    (tmp_path / "bad.csv").write_text("x\nword\n")
    (tmp_path / "f.CTR").write_bytes(mat5.write({"fcontour": [100, 200, 300], "id": "abc"}))
    (tmp_path / "x.wav").write_text("no")
    return tmp_path


def test_contours(spark, folder, monkeypatch):
    read = spark.read.format("contours")
    rows = {r.name: r for r in read.load(str(folder)).collect()}
    assert set(rows) == {"a", "b", "bad", "f", "t"} and [n for n, r in rows.items() if r.error] == ["bad"]
    assert rows["a"].freq == [100, 200, 300] and rows["b"].tempres == pytest.approx(0.005) and rows["f"].ref_id == "abc" and rows["t"].freq == [100, 200]
    good, _ = files.load_contours(spark, f"file://{folder}")
    assert {r.name: r.freq for r in good.collect()} == {n: r.freq for n, r in rows.items() if not r.error and n != "f"}  # that glob tells capitals apart
    assert {r.name for r in spark.read.format("contours").option("format", "csv").option("pattern", "b*").load(f"file://{folder}").collect()} == {"b", "bad"}


def test_files_of_a_task(folder, monkeypatch):
    monkeypatch.setattr(datasource, "TOUCH", 30)
    monkeypatch.setattr(datasource, "TASK_BYTES", 100)
    parts = datasource._ContourReader({"path": str(folder)}).partitions()
    names = [[os.path.basename(p) for p in part.paths] for part in parts]
    assert [n for part in names for n in part] == ["f.CTR", "a.csv", "b.csv", "bad.csv", "t.txt"] and len(parts) > 1
    for path, kind, error in ((folder / "none", "auto", FileNotFoundError), (folder / "a.csv", "auto", NotADirectoryError), (folder / "sub", "auto", ValueError), (folder, "wav", ValueError)):
        with pytest.raises(error):
            datasource._ContourReader({"path": str(path), "format": kind}).partitions()


def test_named_files(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.createDataFrame([(f"f{i}.csv", f"{i}\n") for i in range(20)] + [("none.csv", None)], "file string, value string").repartition(4)
    df.write.format("named_files").mode("append").save(str(out))
    df.limit(3).write.format("named_files").mode("append").save(f"file://{out}")
    assert sorted(os.listdir(out)) == sorted([f"f{i}.csv" for i in range(20)] + ["none.csv"]) and (out / "f7.csv").read_text() == "7\n"
    spark.createDataFrame([("g.csv", "x")], "file string, value string").write.format("named_files").mode("overwrite").save(str(out))
    assert os.listdir(out) == ["g.csv"]
    for rows in ([("a", "1"), ("a", "2")], [("../a", "1")]):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame(rows, "file string, value string").write.format("named_files").mode("append").save(str(out))
    assert os.listdir(out) == ["g.csv"]


def test_an_attempt_that_does_not_count_leaves_nothing(tmp_path):
    from pyspark.sql import Row

    w = datasource._NamedFileWriter(str(tmp_path), False)
    rows = [Row(file="a.csv", value="1"), Row(file="b.csv", value="2")]
    w.write(iter(rows))  # lost after it wrote
    w.commit([w.write(iter(rows)), w.write(iter([]))])
    assert sorted(os.listdir(tmp_path)) == ["a.csv", "b.csv"]
    v = datasource._NamedFileWriter(str(tmp_path), False)
    v.write(iter([Row(file="c.csv", value="3")]))
    v.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a.csv", "b.csv"]


def test_extract(spark, tmp_path):
    (tmp_path / "in").mkdir()
    net = {"weight": np.array([[1.0, 4.0], [2.0, 5.0], [NAN, 6.0]]), "vigilance": 90.0}
    (tmp_path / "in/one.mat").write_bytes(mat5.write({"NET": net, "DATA": [{"name": "a,b", "contour": [1, 2], "category": 1.0, "match": 0.95}, {"name": "b", "contour": [3], "category": NAN, "match": NAN}]}))
    (tmp_path / "in/two.mat").write_bytes(mat5.write({"NET": net, "DATA": [{"name": "c", "contour": [1, 2], "category": 2.0, "match": 95.1234}]}))
    (tmp_path / "in/bad.mat").write_bytes(mat5.write({"X": [1.0]}))
    failed = sinks.extract(spark, f"file://{tmp_path}/in/*.mat", str(tmp_path / "out"))
    assert [r.source for r in failed.collect()] == ["bad"]
    read = lambda n: (tmp_path / "out" / n).read_text()
    assert sorted(os.listdir(tmp_path / "out")) == ["one_assignments.csv", "one_weights.csv", "two_assignments.csv", "two_weights.csv"]
    assert read("one_assignments.csv") == 'contour_name,category,match\n"a,b",1,95.0\nb,,\n' and read("two_assignments.csv") == "contour_name,category,match\nc,2,95.123\n"
    assert read("one_weights.csv") == "cat_1,cat_2\n1.0,4.0\n2.0,5.0\n,6.0\n"
    with pytest.raises(ValueError):
        files.load_categorisation(spark, f"file://{tmp_path}/in/bad.mat")


def test_ids_and_text(spark):
    df = spark.createDataFrame([(k, [f"n{k}", "é"]) for k in range(40)], "category int, names array<string>")
    ids = {r.category: r.ref_contour_id for r in sinks.provenance_ids(df, "r1").collect()}
    assert ids == {k: str(uuid.uuid5(uuid.UUID(NAMESPACE), f"r1/{k}")) for k in range(40)}
    rows = sinks.provenance_rows(df, True, "r1")
    assert sorted(rows.collect()) == sorted(rows.collect()) and all(ids[r.category - 1] == r.ref_contour_id for r in rows.collect()) and rows.count() == 80
    assert {r.x for r in df.limit(1).select(name_id(F.lit("é")).alias("x")).collect()} == {str(uuid.uuid5(uuid.UUID(NAMESPACE), "é"))}
    values = [12.25, 12.35, 0.05, -3.25, 1234567.85, 99999999.0, 0.0, 2.5e-7]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: f"{v:7.1f}" for v in values}
