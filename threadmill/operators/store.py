"""Writes into tables without a MERGE: each gives the new table, to be written as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. Spark drops all but the first rows of a partition before it shuffles."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", k).where("__k = 1").drop("__k")


def keep_last(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    return keep_first(df, keys, [F.desc(order)])


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str] = ("platform", "platform_id"), order: str = "seq", required: Sequence[str] = ()) -> DataFrame:
    """The rows of ``new`` that an insert-or-ignore adds: the first of each key, not in the target, with all required columns. The client is not in the key: the first writer wins over all clients."""
    good = new
    for c in required:
        good = good.where(F.col(c).isNotNull())
    return keep_first(good, keys, [order]).join(target.select(*keys).distinct(), [*keys], "left_anti").select(*new.columns)


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key wins, new rows before old ones."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, [F.desc("__new"), F.desc(order)]).drop("__new")


def delete_duplicates(df: DataFrame, client: str, platform: str | None = None) -> DataFrame:
    """Of a client's rows with one text the smallest seq stays; rows of others are untouched."""
    own = F.col("client") == client
    if platform is not None:
        own = own & (F.col("platform") == platform)
    own = F.coalesce(own, F.lit(False))
    return df.where(~own).unionByName(keep_first(df.where(own), ["text"], ["seq"]))


def merge_posts(old: DataFrame, new: DataFrame, key: str = "platform_id") -> DataFrame:
    """New posts replace old ones."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def merge_comments(old: DataFrame, new: DataFrame, key: str = "platform_id") -> DataFrame:
    """Old comments and the new ones whose id the old do not have; repeats within the new batch stay."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def merge_extractions(old_posts: DataFrame, new_posts: DataFrame, old_comments: DataFrame, new_comments: DataFrame, key: str = "platform_id") -> DataFrame:
    """Both halves of a merge, post by post: the new post replaces the old one but keeps its created_at, its comments are the old ones and the new ones whose id the old have not; ``change`` is new, updated or kept. Posts: key, created_at; comments: post_id, platform_id."""
    was = old_posts.select(F.col(key).alias("__k"), F.col("created_at").alias("__created"))
    fresh = new_posts.join(was, F.col(key) == F.col("__k"), "left").withColumn("change", F.when(F.col("__k").isNull(), "new").otherwise("updated")).withColumn("created_at", F.coalesce("__created", "created_at")).drop("__k", "__created")
    posts = fresh.unionByName(old_posts.join(new_posts.select(key).distinct(), key, "left_anti").withColumn("change", F.lit("kept")), allowMissingColumns=True)
    pair = ["post_id", "platform_id"]
    added = new_comments.join(old_comments.select(*pair).distinct(), pair, "left_anti")
    n = old_comments.unionByName(added, allowMissingColumns=True).groupBy(F.col("post_id").alias("__p")).agg(F.count("*").alias("n_comments"))
    return posts.join(n, F.col(key) == F.col("__p"), "left").drop("__p").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))


def merge_totals(merged: DataFrame) -> DataFrame:
    """Posts, comments, platforms, and new and updated posts of a merge."""
    return merged.agg(F.count("*").alias("total_posts"), F.coalesce(F.sum("n_comments"), F.lit(0)).alias("total_comments"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.count_if(F.col("change") == "new").alias("new_posts"), F.count_if(F.col("change") == "updated").alias("updated_posts"))


def existing_ids(df: DataFrame, client: str, platform: str, posts: DataFrame | None = None, key: str = "platform_id") -> DataFrame:
    """Distinct ids of a client's comments on a platform, of the given posts alone where there are any. posts: post_id."""
    own = df.where((F.col("client") == client) & (F.col("platform") == platform))
    if posts is not None:
        own = own.join(posts.select("post_id").distinct(), "post_id", "left_semi")
    return own.select(key).distinct()


def exists_batch(df: DataFrame, ids: DataFrame, key: str = "platform_id") -> DataFrame:
    """Each distinct asked id, and whether it is there."""
    have = df.select(key).distinct().withColumn("found", F.lit(True))
    return ids.select(key).distinct().join(have, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def changed_since(old: DataFrame, new: DataFrame, key: str = "platform_id") -> DataFrame:
    """An incremental export's rows: new ones, and those whose other columns differ."""
    digest = F.md5(F.to_json(F.struct(*[c for c in new.columns if c != key])))
    was = old.select(key, F.md5(F.to_json(F.struct(*[c for c in new.columns if c != key]))).alias("__was"))
    kind = F.when(F.col("__was").isNull(), F.lit("new")).when(F.col("__was") != digest, F.lit("updated"))
    return new.join(was, key, "left").withColumn("change", kind).drop("__was").where("change is not null")
