"""Tables as posts and comments, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as comments: lang is the platform, source the client, and doc_id the insertion order."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("client"), F.col("lang").alias("platform"), F.col("doc_id").cast("string").alias("platform_id"), F.concat(F.lit("p"), F.col("doc_id") % 50).alias("post_id"), "text", F.col("n_chars").alias("likes"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timed comments: user_id is the author, event_type the platform, value the likes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("author_id"), F.col("event_type").alias("platform"), F.col("ts").alias("published_at"), F.col("value").alias("likes"), F.get_json_object("props", "$.k").alias("post_id"))


def threaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as threads: turns of users are top level, all others replies."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("post_id"), F.col("turn").alias("idx"), "role", "text", (F.col("role") != "user").alias("is_reply"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as posts."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("platform_id"), F.col("o_custkey").alias("account_id"), F.col("o_orderstatus").alias("platform"), F.col("o_orderdate").alias("published_at"), F.col("o_totalprice").alias("likes"))


def post_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as the comments of posts."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("author_id"), F.col("l_quantity").alias("likes"), F.col("l_shipdate").alias("published_at"), F.col("l_returnflag").alias("flag"))
