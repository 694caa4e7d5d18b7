"""What a run saves: parts, company and account documents, interface projections, journals and verified writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.numbers import rounded
from threadmill.operators import tables

#: The columns of a page of comments and of posts.
API_COMMENT = ("platform_id", "post_id", "platform", "author_username", "author_display_name", "text", "likes", "published_at", "parent_id")
API_POST = ("platform_id", "platform", "account_id", "url", "text", "likes", "comments_count", "shares", "published_at", "media_type")


def save(base: str, account: str, platform: str, **parts: DataFrame | None) -> dict[str, str]:
    """Write each part (posts, comments, profile) that has rows below base/platform/account; returns the path of each."""
    saved = {}
    for kind, df in parts.items():
        if df is not None and not df.isEmpty():
            saved[kind] = f"{base.rstrip('/')}/{platform}/{account}/{kind}"
            df.write.mode("overwrite").parquet(saved[kind])
    return saved


def parts(keys: list[str], **frames: DataFrame) -> DataFrame:
    """The same for many accounts at once: keys, ``kind`` and ``rows`` of every part that has rows."""
    counted = [df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind)) for kind, df in frames.items()]
    out = counted[0]
    for df in counted[1:]:
        out = out.unionByName(df)
    return out.select(*keys, "kind", "rows")


def author_name(username: Column, display_name: Column) -> Column:
    """The user name, or the display name where that is missing or empty."""
    return F.coalesce(F.nullif(username, F.lit("")), display_name)


def company_documents(posts: DataFrame, comments: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Metadata of each company's and platform's two documents: ``kind``, ``total`` and the JSON head ``metadata``; rows themselves are written beside them, partitioned by the keys."""
    made = parts(keys, posts=posts, comments=comments).withColumnRenamed("rows", "total")
    return made.withColumn("metadata", F.to_json(F.struct(*keys, "kind", "total", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"))))


def account_document(posts: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """The head of an account's comment file: posts, comments, top level, replies, expected comments and the ratio of both, 0 where none are expected. comments: with ``key`` and parent_id; posts: with ``key`` and comments_count."""
    of_posts = posts.groupBy(key).agg(F.count("*").alias("posts_processed"), F.sum("comments_count").alias("expected_comments"))
    of_comments = comments.groupBy(key).agg(F.count("*").alias("total_comments"), F.count("parent_id").alias("replies"))
    d = of_posts.join(of_comments, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_comments", "replies", "expected_comments")})
    ratio = F.when(F.col("expected_comments") > 0, rounded(F.col("total_comments") / F.col("expected_comments"), 2)).otherwise(0.0)
    return d.select(key, F.lit("2.0").alias("version"), "posts_processed", "total_comments", (F.col("total_comments") - F.col("replies")).alias("top_level_comments"), "replies", "expected_comments", ratio.alias("extraction_ratio"))


def api_comments(df: DataFrame) -> DataFrame:
    """Comments as an answer holds them; an author without a user name has an empty one."""
    return df.withColumn("author_username", F.coalesce("author_username", F.lit(""))).select(*API_COMMENT)


def api_posts(df: DataFrame) -> DataFrame:
    return df.select(*API_POST)


def analyser_object(df: DataFrame, mentions: Column, hashtags: Column) -> DataFrame:
    """Comments as an analyser takes them: engagement, context and metadata as structs. df: platform_id, platform, post_id, text, author, published_at, likes, replies_count, parent_id, post_text, post_type, language."""
    return df.select(
        F.col("platform_id").alias("id"), "platform", "post_id", "text", "author", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct("likes", "replies_count").alias("engagement"),
        F.struct(F.col("parent_id").isNotNull().alias("is_reply"), "parent_id", "post_text", "post_type").alias("context"),
        F.struct(F.col("language").alias("language_hint"), F.lit(False).alias("has_media"), mentions.alias("mentions"), hashtags.alias("hashtags")).alias("metadata"),
    )


def journal_line(action: Column, op_id: Column, *rest: Column) -> Column:
    """One line of an operation journal: START with a time, COMMIT with a checksum and path, ROLLBACK with a reason."""
    return F.concat_ws("|", action, op_id, *[F.coalesce(x, F.lit("")) for x in rest])


def append_journal(lines: DataFrame, path: str) -> None:
    """Append journal lines (column ``value``); a file of a failed attempt is never seen."""
    lines.select("value").write.mode("append").text(path)


def content_digest(df: DataFrame) -> DataFrame:
    """``rows`` and ``digest`` of a table, whatever the order of its rows: row hashes are added up, which combines before it shuffles."""
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_003))), F.lit(0)).alias("digest"))


def save_verified(df: DataFrame, path: str) -> None:
    """Write beside ``path``, read that back, and only then put it in the place of what was there, which stays if anything fails. Between the two renames there is nothing under ``path``; ``tables.VersionedTable`` switches in one step."""
    spark, name = df.sparkSession, path.rstrip("/")
    fresh, old = f"{name}.new-{uuid.uuid4().hex}", f"{name}.old-{uuid.uuid4().hex}"
    want = df.agg(*tables.digest(df)).first()
    df.write.parquet(fresh)
    back = spark.read.schema(df.schema).parquet(fresh)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = at(name).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if back.agg(*tables.digest(back)).first() != want:
        store.delete(at(fresh), True)
        raise OSError(f"{fresh} does not hold what was written")
    was = store.exists(at(name))
    if was and not store.rename(at(name), at(old)):
        raise OSError(f"{name} could not be moved away")
    if not store.rename(at(fresh), at(name)):
        if was:
            store.rename(at(old), at(name))
        raise OSError(f"{fresh} could not be moved to {name}")
    if was:
        store.delete(at(old), True)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Structured log lines as rows."""
    return parse_logs(spark.read.text(path))


def parse_logs(lines: DataFrame) -> DataFrame:
    """lines: value, a JSON object of level, logger, message, timestamp, correlation_id, location and extra; broken lines give nulls."""
    kind = "level STRING, logger STRING, message STRING, timestamp TIMESTAMP, correlation_id STRING, location STRUCT<file: STRING, line: INT, function: STRING>, exception STRING, extra MAP<STRING, STRING>"
    return lines.select(F.from_json("value", kind).alias("l")).select("l.*")


def log_operations(logs: DataFrame) -> DataFrame:
    """Per correlation id: lines, errors, and the longest duration that a line names in milliseconds."""
    return logs.where("correlation_id is not null").groupBy("correlation_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"), F.max(F.col("extra")["duration_ms"].cast("double")).alias("duration_ms"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
