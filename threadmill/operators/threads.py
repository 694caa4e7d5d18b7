"""Threads of comments, rebuilt by windows in each post's input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(order: str = "idx") -> Window:
    return Window.partitionBy("post_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def parents(df: DataFrame, is_reply: Column, order: str = "idx") -> DataFrame:
    """A reply's parent is the last comment before it that isn't one. Ids are ``{post}_c{idx}``."""
    d = df.withColumn("comment_id", F.concat(F.col("post_id"), F.lit("_c"), F.col(order))).withColumn("is_reply", is_reply)
    above = F.last(F.when(~F.col("is_reply"), F.col("comment_id")), ignorenulls=True).over(_upto(order))
    return d.withColumn("parent_id", F.when(F.col("is_reply"), above)).withColumn("depth", F.when(F.col("is_reply"), 2).otherwise(1))


def by_offset(df: DataFrame) -> DataFrame:
    """Replies are set in by over 30 from the smallest positive offset, or begin with @. Texts that are empty leave gaps in the ids."""
    least = F.min(F.when(F.col("offset_left") > 0, F.col("offset_left"))).over(Window.partitionBy("post_id"))
    d = df.withColumn("__least", least)
    reply = F.coalesce(F.col("offset_left") > F.col("__least") + 30, F.lit(False)) | F.startswith("text", F.lit("@"))
    return parents(d.where(F.length(F.trim("text")) > 0), reply).drop("__least")


def by_flag(df: DataFrame, compat: bool = False) -> DataFrame:
    """Replies are marked. With ``compat`` ids count the rows that are left while parents keep the input's count, and so may dangle."""
    d = parents(df, F.col("is_reply"))
    if compat:
        d = d.withColumn("comment_id", F.concat(F.col("post_id"), F.lit("_"), F.row_number().over(Window.partitionBy("post_id").orderBy("idx")) - 1))
    return d


def by_depth(df: DataFrame) -> DataFrame:
    """Replies are marked, or lie in a nested list, or begin with @; a reply's depth is that of its list where this is over 2, else 2. df: is_reply, list_depth."""
    reply = F.col("is_reply") | (F.col("list_depth") > 1) | F.coalesce(F.startswith("text", F.lit("@")), F.lit(False))
    return parents(df, reply).withColumn("depth", F.when(F.col("is_reply"), F.greatest(F.lit(2), F.coalesce("list_depth", F.lit(0)))).otherwise(1))


def distinct_then_parents(df: DataFrame) -> DataFrame:
    """The first comment of each text stays, and replies belong to the last one kept before them that is none."""
    return parents(first_of(df, F.col("text")), F.col("is_reply"))


def first_of(df: DataFrame, key: Column, order: str = "idx") -> DataFrame:
    """The first comment of each key within a post."""
    k = F.row_number().over(Window.partitionBy("post_id", key).orderBy(order))
    return df.withColumn("__k", k).where("__k = 1").drop("__k")


#: Which comments of a post count as the same, by platform.
SAME = {
    "facebook": lambda: F.concat_ws(":", F.col("author"), F.left("text", F.lit(50))),
    "instagram": lambda: F.left(F.trim(F.regexp_replace("text", r"^@[\p{L}\p{N}_.]+", "")), F.lit(100)),
    "twitter": lambda: F.col("text"),
    "linkedin": lambda: F.col("text"),
    "google": lambda: F.concat_ws(":", F.col("reviewer_name"), F.col("text"), F.col("rating")),
}


def flat(df: DataFrame) -> DataFrame:
    """Replies of a post without threads: repeated texts go, ids are ``{post}_r{idx}``."""
    return first_of(df, F.col("text")).withColumn("comment_id", F.concat(F.col("post_id"), F.lit("_r"), F.col("idx"))).withColumn("parent_id", F.lit(None).cast("string"))


def reply_counts(df: DataFrame) -> DataFrame:
    """Each comment with the number of those that name it as parent."""
    n = df.where("parent_id is not null").groupBy(F.col("parent_id").alias("comment_id")).agg(F.count("*").alias("replies_count"))
    return df.drop("replies_count").join(n, "comment_id", "left").withColumn("replies_count", F.coalesce("replies_count", F.lit(0)))


def with_context(df: DataFrame, posts: DataFrame, author: str = "role", order: str = "idx") -> DataFrame:
    """Positions, and the post's ``post_text`` and ``post_type``, null for unknown posts. posts: post_id, text, media_type."""
    of = posts.select("post_id", F.col("text").alias("post_text"), F.col("media_type").alias("post_type"))
    return positions(df, author, order).join(of, "post_id", "left")


def positions(df: DataFrame, author: str = "role", order: str = "idx") -> DataFrame:
    """Position in the thread, and the same author's comment before."""
    w = Window.partitionBy("post_id").orderBy(order)
    return df.withColumn("position", F.row_number().over(w)).withColumn("previous", F.lag("text").over(Window.partitionBy("post_id", author).orderBy(order)))
