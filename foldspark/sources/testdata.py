"""The driver's tables as light curves and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: a user is a source, days since 2024 the time, weeks the quarters."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    time = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz")) / F.lit(8.64e10)
    events = table(spark, sf_dir, "events").withColumn("time", time)
    quality = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 16).otherwise(0)
    return events.select(
        F.col("user_id").alias("kepid"), "time", F.col("value").alias("flux"), (F.lit(1.0) + F.lit(0.01) * F.col("value")).alias("flux_err"),
        quality.cast("long").alias("quality"), F.floor(F.col("time") / 7).cast("long").alias("quarter"), "event_id",
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as signals of the customers that are stars."""
    orders = table(spark, sf_dir, "orders")
    key, first = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    disposition = F.when(F.col("o_orderstatus") == "F", "FALSE POSITIVE").when(F.col("o_orderstatus") == "O", "CONFIRMED").otherwise("CANDIDATE")
    pipeline = F.when(first == "1", "CANDIDATE").when(first == "2", "FALSE POSITIVE").when(first == "3", "candidate ").when(first == "4", "NOT DISPOSITIONED")
    return orders.select(
        F.col("o_custkey").alias("kepid"),
        F.concat(F.lit("K"), F.lpad(key.cast("string"), 8, "0")).alias("kepoi_name"),
        disposition.alias("koi_disposition"),
        pipeline.alias("koi_pdisposition"),
        (F.lit(0.5) + (key % 97) / F.lit(10.0)).alias("koi_period"),
        ((key % 31) / F.lit(10.0)).alias("koi_time0bk"),
        F.when(key % 23 != 0, 1.0 + (key % 7)).cast("double").alias("koi_duration"),
        F.col("o_totalprice").alias("koi_depth"),
        key.alias("o_orderkey"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal of each star."""
    return catalog(spark, sf_dir)
