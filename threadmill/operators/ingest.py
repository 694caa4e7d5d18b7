"""From captured records to stored ones: normalising, incremental selection, appending and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.text import clean_comment, first_present
from threadmill.operators import query, store

#: Under which names captured records give an author's fields, the first that is present counts.
AUTHOR_FIELDS = {
    "platform_id": ("id", "user_id"),
    "username": ("username", "screen_name"),
    "display_name": ("name", "full_name"),
    "profile_url": ("profile_url", "url"),
    "profile_image": ("profile_image", "avatar"),
}


def author(fields: dict[str, Column]) -> Column:
    """An author struct from captured fields by name."""
    none = F.lit(None).cast("string")
    return F.struct(*[(first_present(*[fields[n] for n in names if n in fields]) if any(n in fields for n in names) else none).alias(out) for out, names in AUTHOR_FIELDS.items()])


def comments(raw: DataFrame) -> DataFrame:
    """Stored comments from captured ones. raw: post_id, and any of id, text, likes, depth, parent_id, author. Missing ids become ``{post}_unknown``, texts empty, likes 0, depth 1; an author's name is its id, user name and display name. What is not stored stays in raw_data."""
    has = set(raw.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    name = col("author", "string")
    return raw.select(
        "post_id",
        F.coalesce(col("id", "string"), F.concat(F.col("post_id").cast("string"), F.lit("_unknown"))).alias("platform_id"),
        F.coalesce(clean_comment(col("text", "string")), F.lit("")).alias("text"),
        F.when(name.isNotNull(), F.struct(name.alias("platform_id"), name.alias("username"), name.alias("display_name"))).alias("author"),
        F.coalesce(col("likes", "long"), F.lit(0)).alias("likes"),
        col("parent_id", "string").alias("parent_id"),
        F.to_json(F.struct(F.coalesce(col("depth", "int"), F.lit(1)).alias("depth"), *[F.col(c) for c in raw.columns if c not in ("depth",)])).alias("raw_data"),
    )


def selected(posts: DataFrame, history: DataFrame, known: DataFrame) -> DataFrame:
    """Posts that an incremental run takes: not older than their account's last post date, where there is one, and not known. history: account_id, last_post_date."""
    marked = posts.join(history.select("account_id", "last_post_date"), "account_id", "left")
    fresh = marked.where(F.col("last_post_date").isNull() | F.col("published_at").isNull() | (F.col("published_at") >= F.col("last_post_date")))
    return fresh.drop("last_post_date").join(known.select("platform_id").distinct(), "platform_id", "left_anti")


def totals(posts: DataFrame, comments_: DataFrame, stored: DataFrame) -> DataFrame:
    """posts_scraped, comments_found, new_saved and duplicates_skipped of a run; posts that have stored comments are saved, but their comments are not looked at."""
    open_posts = query.without_comments(posts, stored)
    seen = comments_.join(open_posts.select(F.col("platform_id").alias("post_id")), "post_id", "left_semi")
    saved = store.insert_ignore(stored, seen)
    n = posts.agg(F.count("*").alias("posts_scraped"))
    for part in (seen.agg(F.count("*").alias("comments_found")), saved.agg(F.count("*").alias("new_saved"))):
        n = n.join(part)
    return n.withColumn("duplicates_skipped", F.col("comments_found") - F.col("new_saved"))


def history(old: DataFrame, posts: DataFrame, at: Column) -> DataFrame:
    """Bookkeeping by client, platform and account: the newest post's date replaces what was there."""
    new = posts.groupBy("client", "platform", "account_id").agg(F.max("published_at").alias("last_post_date"), F.count("*").alias("posts_scraped")).withColumn("completed_at", at)
    return store.upsert(old, new, ["client", "platform", "account_id"], "completed_at")


def append(spark: SparkSession, path: str, new: DataFrame, schema: str) -> DataFrame:
    """Add to a stored table, partitioned by client and platform, the rows that it doesn't hold; returns the table. Running it again adds nothing."""
    try:
        old = spark.read.schema(schema).parquet(path)
        keys = old.select("platform", "platform_id")
        keys.schema, keys.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], schema)
    store.insert_ignore(old, new).write.mode("append").partitionBy("client", "platform").parquet(path)
    return spark.read.schema(schema).parquet(path)
