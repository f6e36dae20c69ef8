"""Command line: train, predict, export, extract, plot (the tables behind the figures). Errors go to stderr with status 1."""

from __future__ import annotations

import argparse
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import contours as fc
from undula.operators import art, pairs, predict, summaries
from undula.sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="undula", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def scan(q):
        q.add_argument("--input-dir", required=True)
        q.add_argument("--format", default="auto", choices=("auto", *files.FORMATS))
        q.add_argument("--frequency-column", type=int, default=0)

    t = sub.add_parser("train", help="categorise a directory of contours")
    scan(t)
    t.add_argument("--output", required=True)
    t.add_argument("--vigilance", type=float, default=85.0)
    t.add_argument("--learning-rate", type=float, default=0.1)
    t.add_argument("--bias", type=float, default=1e-6)
    t.add_argument("--max-categories", type=int, default=50)
    t.add_argument("--max-iterations", type=int, default=50)
    t.add_argument("--warp-factor", type=int, default=3)
    t.add_argument("--seed", type=int)
    t.add_argument("--no-resample", action="store_true")
    t.add_argument("--sample-interval", type=float, default=0.01)
    t.add_argument("--default-tempres", type=float, default=0.01)
    t.add_argument("--max-contour-length", type=int)
    t.add_argument("--strict", action="store_true", help="refuse contours with missing, infinite or non-positive values")
    t.add_argument("--export-refs")
    t.add_argument("--export-categories")
    for flag in ("purge-empty", "recat-single", "compare-warped", "deprioritize-lone"):
        t.add_argument(f"--{flag}", action="store_true")
    q = sub.add_parser("predict", help="assign contours to a saved model's prototypes")
    scan(q)
    q.add_argument("--model", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--legacy-defaults", action="store_true", help="vigilance 85, bias 0 and warp factor 3, no resampling, whatever the model was trained with")
    e = sub.add_parser("export", help="write a saved model's prototypes or categories as CSV")
    e.add_argument("what", choices=("all", "references", "categories"))
    e.add_argument("--model", required=True)
    e.add_argument("--output-dir", required=True)
    x = sub.add_parser("extract", help="write assignments and weights of saved MATLAB categorisations as CSV")
    x.add_argument("--input", required=True, help="a file, a directory or a glob")
    x.add_argument("--output-dir", required=True)
    r = sub.add_parser("plot", help="write the tables of a saved model's report")
    r.add_argument("--model", required=True)
    r.add_argument("--output-dir", required=True)
    return p


def prepared(contours: DataFrame, a: dict) -> DataFrame:
    """Contours on the model's time grid."""
    if a["resample"]:
        contours = contours.withColumn("freq", fc.resample(F.col("freq"), fc.safe_tempres(F.col("tempres"), a["default_tempres"]), F.lit(a["sample_interval"])))
    return contours.withColumn("freq", fc.cap_length(F.col("freq"), a["max_contour_length"])) if a["max_contour_length"] else contours


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    contours, failed = files.load_contours(spark, a.input_dir, a.format, a.frequency_column)
    for r in failed.toLocalIterator():
        print(f"left out {r.path}: {r.error}", file=sys.stderr)
    grid = {"resample": not a.no_resample, "sample_interval": a.sample_interval, "default_tempres": a.default_tempres, "max_contour_length": a.max_contour_length}
    params = art.Params(a.vigilance, a.learning_rate, a.bias, a.max_categories, a.max_iterations, a.warp_factor, a.seed, a.purge_empty, a.recat_single, a.compare_warped, a.deprioritize_lone)
    scanned = prepared(contours, grid).select("contour_id", "name", "freq", "tempres")
    results = art.fit(scanned, {"run": params}, a.strict)
    results.write.mode("overwrite").parquet(f"{a.output}/results")  # trained once, read by each table
    results = spark.read.parquet(f"{a.output}/results")
    named = art.assignments(results).join(scanned.select("contour_id", "name"), "contour_id").drop("run_id")
    kept = {k: v for k, v in (grid | asdict(params) | {"warp_factor": a.warp_factor}).items() if v is not None}
    parameters = spark.createDataFrame([(k, float(v)) for k, v in kept.items()], "name string, value double")
    raw = contours.select("contour_id", "name", "freq", "tempres")
    tables = {"contours": scanned, "raw": raw, "assignments": named, "prototypes": art.prototypes(results).drop("run_id"), "history": art.history(results), "meta": art.meta(results), "provenance": summaries.provenance(named), "parameters": parameters}
    sinks.save_model(tables, a.output)
    if a.export_refs:
        sinks.export_prototypes(tables["prototypes"], a.export_refs)
    if a.export_categories:
        sinks.export_csv(sinks.assignment_rows(named), a.export_categories, "contour_name")
    print(summaries.stats_table(named).toPandas().to_string(index=False))


def run_predict(spark: SparkSession, a: argparse.Namespace) -> None:
    model = sinks.load_model(spark, a.model)
    p = {r.name: r.value for r in model["parameters"].collect()}
    contours, _ = files.load_contours(spark, a.input_dir, a.format, a.frequency_column)
    if a.legacy_defaults:
        found = predict.predict(contours, model["prototypes"])
    else:
        grid = {"resample": bool(p["resample"]), "sample_interval": p["sample_interval"], "default_tempres": p["default_tempres"], "max_contour_length": int(p.get("max_contour_length", 0))}
        found = predict.predict(prepared(contours, grid), model["prototypes"], p["vigilance"], p["bias"], int(p["warp_factor"]))
    named = found.join(contours.select("contour_id", "name"), "contour_id")
    sinks.export_csv(sinks.assignment_rows(named), a.output, "contour_name")
    print(summaries.prediction_summary(named).toPandas().to_string(index=False))


def export(spark: SparkSession, a: argparse.Namespace) -> None:
    model = sinks.load_model(spark, a.model)
    if a.what in ("all", "references"):
        sinks.export_prototypes(model["prototypes"], f"{a.output_dir}/references")
        if "provenance" in model:
            sinks.export_csv(sinks.provenance_rows(model["provenance"], run=a.model), f"{a.output_dir}/provenance", "category", "parent_contour_name")
    if a.what in ("all", "categories"):
        sinks.export_csv(sinks.assignment_rows(model["assignments"]), f"{a.output_dir}/categories", "contour_name")


def plot(spark: SparkSession, a: argparse.Namespace) -> None:
    model = sinks.load_model(spark, a.model)
    w = {r.name: int(r.value) for r in model["parameters"].filter("name = 'warp_factor'").collect()}.get("warp_factor", 3)
    tables = summaries.report(model["contours"], model["assignments"], pairs.prototype_pairs(model["prototypes"], w), model["prototypes"], model["history"], raw=model.get("raw"), w=w)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{a.output_dir}/{name}")


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in sinks.extract(spark, a.input, a.output_dir).toLocalIterator():
        print(f"left out {r.source}: {r.error}", file=sys.stderr)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("undula").getOrCreate()
    try:
        {"train": train, "predict": run_predict, "export": export, "extract": extract, "plot": plot}[a.command](spark, a)
    except (ValueError, OSError, RuntimeError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
