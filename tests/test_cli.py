"""The command line end to end, and streaming assignment."""

import glob

import numpy as np
from pyspark.sql import functions as F

from undula import cli
from undula.operators import predict
from undula.streaming.assign import assign


def test_train_predict_export_plot(spark, tmp_path, capsys):
    d, m, out = (f"file://{tmp_path}/{x}" for x in ("in", "model", "out"))
    (tmp_path / "in").mkdir()
    for i in range(6):
        y = 1000 + 300 * np.sin(np.linspace(0, 3 + 4 * (i % 2), 40)) + i
        (tmp_path / f"in/c{i}.csv").write_text("Time [ms],Frequency [Hz]\n" + "".join(f"{5 * k},{v}\n" for k, v in enumerate(y)))
    assert cli.main(["train", "--input-dir", d, "--output", m, "--vigilance", "96", "--seed", "1", "--export-refs", f"{out}/refs"]) == 0
    assert cli.main(["predict", "--input-dir", d, "--model", m, "--output", f"{out}/predicted"]) == 0
    assert cli.main(["export", "all", "--model", m, "--output-dir", out]) == 0
    assert cli.main(["plot", "--model", m, "--output-dir", f"{out}/report"]) == 0
    assert glob.glob(f"{tmp_path}/out/refs/refContour_*.csv") and glob.glob(f"{tmp_path}/out/report/*")
    trained = spark.read.csv(f"{out}/categories", header=True).toPandas().set_index("contour_name").category
    predicted = spark.read.csv(f"{out}/predicted", header=True).toPandas().set_index("contour_name").category
    assert (trained == predicted.reindex(trained.index)).all() and trained["c0"] != trained["c1"]
    assert cli.main(["predict", "--input-dir", f"{d}/none", "--model", m, "--output", out]) == 1


def test_stream(spark, tmp_path):
    rows = [(i, [100.0 + i, 200.0, 300.0 + 40 * (i % 3)]) for i in range(12)]
    df = spark.createDataFrame(rows, "contour_id long, freq array<double>")
    p = spark.createDataFrame([(0, [100.0, 200.0, 300.0]), (1, [100.0, 200.0, 380.0])], "category int, weight array<double>")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = assign(stream, p, 90.0).writeStream.format("memory").queryName("assigned").start()
    q.processAllAvailable()
    q.stop()
    got = {r.contour_id: (r.category, round(r.match, 9)) for r in spark.table("assigned").collect()}
    want = {r.contour_id: (r.category, round(r.match, 9)) for r in predict.predict(df, p, 90.0).select("contour_id", F.col("category").cast("int").alias("category"), "match").collect()}
    assert got == want
