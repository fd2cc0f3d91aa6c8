"""Graphs derived from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileflow.operators.order import numbered


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def next_items(spark: SparkSession, sf_dir: str, key: str = "l_partkey", flag: str | None = None) -> DataFrame:
    """An edge from each order line's key to the next line's, weighted by the least quantity; flag, if given, restricts both lines."""
    lines = _table(spark, sf_dir, "lineitem")
    if flag:
        lines = lines.where(F.col("l_returnflag") == flag)
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("line"), F.col(key).alias("src"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col(key).alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    return a.join(b, ["l_orderkey", "line"]).groupBy("src", "dst").agg(F.min("weight").alias("weight"))


def next_users(spark: SparkSession, sf_dir: str, event_type: str = "purchase") -> DataFrame:
    """An edge from each event's user to the next event's; weight counts them."""
    events = _table(spark, sf_dir, "events").where(F.col("event_type") == event_type).select("ts", "event_id", "user_id")
    placed = numbered(events, ["ts", "event_id"], "place")
    a = placed.select(F.col("user_id").alias("src"), (F.col("place") + 1).alias("place"))
    b = placed.select(F.col("user_id").alias("dst"), "place")
    return a.join(b, "place").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def supplier_parts(spark: SparkSession, sf_dir: str, boundary: int = 10_000_000) -> DataFrame:
    """Ratings: parts (users) and suppliers (movies, from boundary up), rated by the mean quantity, rounded."""
    lines = _table(spark, sf_dir, "lineitem")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg("l_quantity")).cast("long").alias("weight"))
    return pairs.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + boundary).alias("dst"), "weight")
