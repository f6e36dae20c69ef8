"""Exports: the model as tables, prototypes, provenance and assignments as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions.contours import fixed, name_id
from undula.sources import datasource, files

MODEL = ("assignments", "prototypes", "history", "meta", "provenance")


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table (and parameters) as Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark, path: str) -> dict[str, DataFrame]:
    out = {}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path):
        if status.isDirectory():
            name = status.getPath().getName()
            out[name] = spark.read.parquet(f"{path}/{name}")
    return out


def prototype_text(prototypes: DataFrame, one_based: bool = True, prefix: str = "refContour") -> DataFrame:
    """file, value: the CSV text of each prototype that has a value; missing values are left out."""
    rows = prototypes.select("category", F.filter("weight", lambda x: x.isNotNull() & ~F.isnan(x)).alias("w")).filter(F.size("w") > 0)
    return rows.select(F.concat(F.lit(prefix + "_"), (F.col("category") + (1 if one_based else 0)).cast("string"), F.lit(".csv")).alias("file"), F.concat(F.array_join(F.transform("w", fixed), "\n"), F.lit("\n")).alias("value"))


def export_files(rows: DataFrame, directory: str) -> None:
    """One file for each row of (file, value), written by the tasks; those of the same names are replaced."""
    datasource.register(rows.sparkSession)
    rows.select("file", "value").write.format("named_files").mode("append").save(directory)


def export_prototypes(prototypes: DataFrame, directory: str, one_based: bool = True, prefix: str = "refContour") -> int:
    """One CSV per prototype that has a value; how many there are."""
    rows = prototype_text(prototypes, one_based, prefix)
    export_files(rows, directory)
    return rows.count()


def provenance_ids(provenance: DataFrame, run: str = "run") -> DataFrame:
    """category, ref_contour_id: an id for each category, made of the run's name and the category, so that it stays the same however often it is computed."""
    return provenance.select("category", name_id(F.concat(F.lit(f"{run}/"), F.col("category").cast("string"))).alias("ref_contour_id")).distinct()


def provenance_rows(provenance: DataFrame, one_based: bool = False, run: str = "run") -> DataFrame:
    """category, ref_contour_id, parent_contour_name. provenance: category, names."""
    ids = name_id(F.concat(F.lit(f"{run}/"), F.col("category").cast("string")))
    return provenance.select((F.col("category") + (1 if one_based else 0)).alias("category"), ids.alias("ref_contour_id"), F.explode("names").alias("parent_contour_name"))


def export_csv(df: DataFrame, path: str, *order: str) -> None:
    """df as CSV with a header, in order; an empty one is its header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def assignment_rows(named: DataFrame, one_based: bool = False) -> DataFrame:
    """contour_name, category (text, `uncategorized` for none), match (three decimals)."""
    category = F.coalesce((F.col("category") + (1 if one_based else 0)).cast("string"), F.lit("uncategorized"))
    return named.select(F.col("name").alias("contour_name"), category.alias("category"), F.format_string("%.3f", F.col("match")).alias("match"))


def categorisation_rows(assigned: DataFrame) -> DataFrame:
    """contour_name, category from 1, match in per cent (fractions, at most 2 at the top, are scaled)."""
    top = assigned.agg(F.max("match").alias("top"))  # one row
    rows = assigned.crossJoin(F.broadcast(top))
    return rows.select(F.col("name").alias("contour_name"), (F.col("category") + 1).alias("category"), F.bround(F.when(F.col("top") <= 2, F.col("match") * 100).otherwise(F.col("match")), 3).alias("match"))


def wide_prototypes(long: DataFrame, n_categories: int) -> DataFrame:
    """pos, cat_1 .. cat_n of the long form (pos, category, value)."""
    names = [f"cat_{i + 1}" for i in range(n_categories)]
    return long.withColumn("c", F.concat(F.lit("cat_"), (F.col("category") + 1).cast("string"))).groupBy("pos").pivot("c", names).agg(F.first("value")).orderBy("pos")


def categorisation_files(tables: dict[str, DataFrame]) -> DataFrame:
    """file, value: for each source of files.load_categorisations, <source>_assignments.csv (as categorisation_rows has it) and <source>_weights.csv (a column for each category, by position).

    A source is one saved file, so its two texts are no larger than what was read from it.
    """
    a = tables["assignments"]
    top = a.groupBy("source").agg(F.max("match").alias("top"))
    m = F.bround(F.when(F.col("top") <= 2, F.col("match") * 100).otherwise(F.col("match")), 3)
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", quoted(F.col("name")), F.coalesce((F.col("category") + 1).cast("string"), F.lit("")), F.coalesce(m.cast("string"), F.lit("")))
    lines = a.join(top, "source").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("contour_id", line.alias("line")))).alias("x"))
    text = lambda head, rows: F.concat(F.array_join(F.concat(F.array(head), rows), "\n"), F.lit("\n"))
    first = lines.select(F.concat("source", F.lit("_assignments.csv")).alias("file"), text(F.lit("contour_name,category,match"), F.col("x.line")).alias("value"))
    w = tables["prototypes"].groupBy("source").agg(F.array_sort(F.collect_list(F.struct("category", "weight"))).alias("x"))
    head = F.array_join(F.transform("x", lambda c: F.concat(F.lit("cat_"), (c["category"] + 1).cast("string"))), ",")
    cell = lambda c, i: F.coalesce(F.when(~F.isnan(F.get(c["weight"], i)), F.get(c["weight"], i)).cast("string"), F.lit(""))
    rows = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("x", lambda c: F.size(c["weight"]))) - 1), lambda i: F.array_join(F.transform("x", lambda c: cell(c, i)), ","))
    second = w.select(F.concat("source", F.lit("_weights.csv")).alias("file"), text(head, rows).alias("value"))
    return first.unionByName(second)


def extract(spark, path: str, directory: str) -> DataFrame:
    """Both CSVs of every saved categorisation at path; source and error of those that can't be read."""
    tables = files.load_categorisations(spark, path)
    export_files(categorisation_files(tables), directory)
    return tables["failed"]
