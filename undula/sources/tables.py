"""Contours from tables of a warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_points(points: DataFrame, key: str, order: list[str], value: str, *more: Column) -> DataFrame:
    """contour_id, freq, and more aggregates: the values of each key in order. A key's points are one contour and so one row."""
    x = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_value"))))
    found = points.groupBy(F.col(key).alias("contour_id")).agg(x.alias("x"), *more)
    return found.select("contour_id", F.col("x._value").alias("freq"), *found.columns[2:])


def event_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contour_id (user), freq (values by time), tempres (mean step in seconds)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value").filter("value is not null")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.when(F.count("*") > 1, (F.max(micros) - F.min(micros)) / 1e6 / (F.count("*") - 1)).otherwise(0.0)
    return from_points(e, "user_id", ["ts", "event_id"], "value", span.alias("tempres"))


def embedding_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contour_id (vector), label, freq (values around 1000)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("contour_id"), "label", F.transform("embedding", lambda x: 1000 * (1 + x.cast("double"))).alias("freq"))


def order_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contour_id (customer), freq (order totals by date)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return from_points(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


def order_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contour_id (customer), n (points) of order_contours, counted without the values."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("contour_id")).agg(F.count("*").cast("int").alias("n"))
