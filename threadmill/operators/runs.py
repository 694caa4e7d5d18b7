"""Bookkeeping of runs: counters, histograms, monitors, remaining time and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.dates import format_duration


def recorded(df: DataFrame) -> DataFrame:
    """The five lifetime counters of all runs. df: posts, comments, errors, rate_limits."""
    return df.agg(F.count("*").alias("total_extractions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("posts", "comments", "errors", "rate_limits")])


def histograms(df: DataFrame, bounds: dict[str, list[float]]) -> DataFrame:
    """``name``, ``bucket`` (the number of bounds that a value reaches) and ``n``. Durations count for every run, posts and comments only where there are any. df: duration, posts, comments."""
    points = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in (("extraction_duration", "duration"), ("posts_per_extraction", "posts"), ("comments_per_extraction", "comments"))])
    d = df.select(F.explode(points).alias("p")).select("p.*").where((F.col("name") == "extraction_duration") | (F.col("value") > 0))
    bucket = F.coalesce(*[F.when(F.col("name") == name, sum((F.col("value") >= b).cast("int") for b in at)) for name, at in bounds.items()])
    return d.where(F.col("value").isNotNull()).groupBy("name", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def monitor(df: DataFrame, key: str, ts: str = "published_at") -> DataFrame:
    """Summary of each account's posts: posts, comments, errors, seconds between first and last, posts a minute and comments a post; 0 where no time has gone. df: comments, failed."""
    ok = ~F.col("failed")
    seconds = F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))
    d = df.groupBy(key).agg(F.count_if(ok).alias("posts"), F.coalesce(F.sum(F.when(ok, F.col("comments"))), F.lit(0)).alias("comments"), F.count_if("failed").alias("errors"), seconds.alias("duration_seconds"))
    moved = (F.col("duration_seconds") > 0) & (F.col("posts") > 0)
    return d.withColumn("extraction_rate", F.when(moved, F.col("posts") / F.col("duration_seconds") * 60).otherwise(0.0)).withColumn("avg_comments_per_post", F.when(moved, F.col("comments") / F.col("posts")).otherwise(0.0))


def eta(df: DataFrame, total: int, *keys: str) -> DataFrame:
    """Mean seconds of what is done times what is left of ``total``, as text; without any done: calculating... df: duration."""
    left = F.avg("duration") * (F.lit(total) - F.count("duration"))
    return df.groupBy(*keys).agg(F.count("duration").alias("done"), F.coalesce(format_duration(left.cast("double")), F.lit("calculating...")).alias("eta"))


def last_extraction(history: DataFrame, asked: DataFrame) -> DataFrame:
    """Each asked client, platform and account with its last post date, null where none is known."""
    keys = ["client", "platform", "account_id"]
    return asked.select(*keys).join(history.groupBy(*keys).agg(F.max("last_post_date").alias("last_post_date")), keys, "left")


def extract_all(accounts: DataFrame, done: DataFrame, key: str = "account_id") -> DataFrame:
    """One row for each enabled account: its statistics, or its error where the run failed; accounts without a run have an error too. accounts: key, enabled; done: key, posts, comments, error."""
    d = accounts.where("enabled").select(key).join(done.withColumn("__ran", F.lit(True)), key, "left")
    failed = F.coalesce(F.col("error"), F.when(F.col("__ran").isNull(), "no result"))
    return d.select(key, *[F.when(failed.isNull(), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("posts", "comments")], failed.alias("error"))


def statistics(posts: DataFrame, comments: DataFrame, platform: str = "platform", author: str = "author_id") -> DataFrame:
    """Posts, comments, distinct authors and the date range of posts, of each platform and - with platform null - of all. Authors are counted over distinct pairs, so that a large platform is split."""
    p = posts.groupBy(platform).agg(F.count("*").alias("posts"), F.min("published_at").alias("earliest_post"), F.max("published_at").alias("latest_post"))
    per = comments.groupBy(platform, author).agg(F.count("*").alias("n"))
    c = per.groupBy(platform).agg(F.sum("n").alias("comments"), F.count(author).alias("unique_authors"))
    one = p.join(c, platform, "full")
    everyone = comments.groupBy(author).agg(F.count("*").alias("n")).agg(F.sum("n").alias("comments"), F.count(author).alias("unique_authors"))
    of_posts = p.agg(F.sum("posts").alias("posts"), F.min("earliest_post").alias("earliest_post"), F.max("latest_post").alias("latest_post"))
    every = of_posts.join(everyone).withColumn(platform, F.lit(None).cast(posts.schema[platform].dataType))
    columns = [platform, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("posts", "comments", "unique_authors")], "earliest_post", "latest_post"]
    return one.select(*columns).unionByName(every.select(*columns))


def topic_counts(df: DataFrame, topics: Column) -> DataFrame:
    """Rows that name each topic; a topic counts once a row."""
    return df.select(F.explode(F.array_distinct(topics)).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
