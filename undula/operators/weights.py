"""Prototype tables (category int, weight array<double>): add, delete, purge, average, reindex."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.functions.contours import spread, valid_weight


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "category int, weight array<double>")


def add(prototypes: DataFrame, contour: list[float]) -> DataFrame:
    """prototypes with a copy of contour as the next category."""
    spark = prototypes.sparkSession
    at = prototypes.agg((F.coalesce(F.max("category"), F.lit(-1)) + 1).cast("int").alias("category"))
    return prototypes.unionByName(at.crossJoin(spark.createDataFrame([(list(map(float, contour)),)], "weight array<double>")))


def _check(prototypes: DataFrame, category: int) -> None:
    if prototypes.filter(F.col("category") == category).isEmpty():
        raise IndexError(f"there is no category {category}")


def delete(prototypes: DataFrame, category: int) -> DataFrame:
    """prototypes without a category; those above it move down by one."""
    _check(prototypes, category)
    return prototypes.filter(F.col("category") != category).withColumn("category", moved(F.col("category"), category))


def moved(column, category: int):
    return (column - F.when(column > category, 1).otherwise(0)).cast("int")


def delete_reindex(prototypes: DataFrame, assignments: DataFrame, category: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without an empty category; uncategorised rows stay so."""
    if not assignments.filter(F.col("category") == category).isEmpty():
        raise ValueError(f"category {category} still has members")
    return delete(prototypes, category), assignments.withColumn("category", moved(F.col("category"), category))


def purge(prototypes: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both tables without prototypes that have no member, numbered anew, and how many went."""
    used = assignments.filter("category is not null").select("category").distinct()
    if not used.join(prototypes, "category", "left_anti").isEmpty():
        raise IndexError("an assignment names a category that has no prototype")
    # as many rows as there are categories
    number = used.withColumn("new", (F.row_number().over(Window.orderBy("category")) - 1).cast("int"))
    kept = prototypes.join(number, "category").select(F.col("new").alias("category"), "weight")
    again = assignments.join(number, "category", "left").withColumn("category", F.col("new")).drop("new")
    return kept, again, prototypes.count() - used.count()


def average(prototypes: DataFrame, contours: DataFrame, assignments: DataFrame) -> DataFrame:
    """Prototypes brought to the mean length (half to even) of their members; those without members stay."""
    size = assignments.filter("category is not null").join(contours, "contour_id").groupBy("category").agg(F.greatest(F.lit(1), F.bround(F.avg(F.size("freq")))).cast("int").alias("n"))
    v = valid_weight(F.col("weight"))
    return prototypes.join(size, "category", "left").select("category", F.when(F.col("n").isNull() | (F.size(v) == 0), F.col("weight")).otherwise(spread(v, F.col("n"))).alias("weight"))


def active(prototypes: DataFrame) -> int:
    """Categories with a positive value."""
    return prototypes.filter(F.exists("weight", lambda x: (x > 0) & ~F.isnan(x))).count()


def long_form(prototypes: DataFrame) -> DataFrame:
    """pos, category, value, padded with null to the longest prototype."""
    longest = prototypes.agg(F.max(F.size("weight")).alias("n"))
    rows = prototypes.crossJoin(F.broadcast(longest))  # one row
    return rows.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("weight", i))).alias("pos", "value"), "category").select("pos", "category", "value")
