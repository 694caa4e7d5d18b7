"""Queries that write with a sink of the library and return what a reader finds there, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmill.functions import safety
from threadmill.operators import documents, export, results, tables
from threadmill.plans.core import register
from threadmill.sources import adapters as a
from threadmill.session import shared_path

OPTIONS = {"client": "acme", "exported_at": "2024-02-01"}


def _turns(s, d):
    return a.table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("platform"), "text", F.col("turn").cast("long").alias("likes"))


def _path(s, name):
    return shared_path(s, f"{name}-{uuid.uuid4().hex}")


TURNS = "(SELECT conv_id || '-' || turn AS id, role AS platform, text, turn::BIGINT AS likes FROM conversations)"


@register("written_csv", f"SELECT id, platform, md5(coalesce(text, '')) AS text, likes FROM {TURNS}")
def _(s, d):
    at = export.write(_turns(s, d), "csv", _path(s, "csv"), "f", options=export.preset("excel_friendly"))
    back = s.read.csv(at, header=True, multiLine=True, escape='"', schema="id string, platform string, text string, likes long")
    return back.withColumn("text", F.md5(F.coalesce("text", F.lit(""))))


@register("written_jsonl", f"SELECT 'comment' AS type, id, platform, md5(text) AS text, likes, NULL::BIGINT AS total_comments FROM {TURNS} UNION ALL SELECT 'metadata', NULL, NULL, NULL, NULL, count(*) FROM {TURNS}")
def _(s, d):
    at = export.write(_turns(s, d), "jsonl", _path(s, "jsonl"), "f", options=export.Options(ensure_ascii=True, **OPTIONS))
    return s.read.json(at, schema="type string, id string, platform string, text string, likes long, total_comments long").withColumn("text", F.md5("text"))


@register("written_parquet", f"SELECT id AS name, likes FROM {TURNS}")
def _(s, d):
    return s.read.parquet(export.write(_turns(s, d), "parquet", _path(s, "parquet"), "f", options=export.Options(include=("id", "likes"), rename={"id": "name"})))


@register("written_json", f"""
    WITH t AS (SELECT to_json({{'platform': platform, 'likes': likes}}) AS line FROM {TURNS})
    SELECT field, value, count(*) AS n FROM (
        SELECT 'likes' AS field, likes::VARCHAR AS value FROM {TURNS} UNION ALL SELECT 'platform', platform FROM {TURNS}
        UNION ALL SELECT 'client', 'acme' UNION ALL SELECT 'total_comments', count(*)::VARCHAR FROM {TURNS}) GROUP BY ALL""")
def _(s, d):
    """The lines of one large file are read by many tasks; a row's fields stand at six spaces, those of the metadata at four."""
    at = export.write(_turns(s, d), "json", _path(s, "json"), "f.json", options=export.Options(exclude=("id", "text"), sort_keys=True, **OPTIONS))
    found = s.read.text(at).select(*[F.regexp_extract("value", r'^(?: {4}|      )"(likes|platform|client|total_comments)": "?([^",]*)"?,?$', k).alias(c) for k, c in ((1, "field"), (2, "value"))])
    return found.where("field <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


_account = "(SELECT c_nationkey AS account_id, o_orderkey, o_custkey % 9 AS comments_count FROM orders JOIN customer ON o_custkey = c_custkey)"


@register("account_files", f"""
    WITH p AS (SELECT account_id, count(*) AS posts, sum(comments_count) AS expected FROM {_account} GROUP BY 1),
    c AS (SELECT account_id, count(*) AS comments, count(*) FILTER (l_linenumber > 1) AS replies, sum(l_quantity)::BIGINT AS likes FROM {_account} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT account_id::VARCHAR AS account_id, posts::BIGINT AS posts, comments, comments AS listed, replies, expected::BIGINT AS expected, round_even(comments / expected, 2) AS ratio, likes FROM p JOIN c USING (account_id)""")
def _(s, d):
    o = a.table(s, d, "orders").join(a.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("account_id"), "o_orderkey", (F.col("o_custkey") % 9).alias("comments_count"))
    c = a.table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("account_id", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").cast("long").alias("likes"), F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")).alias("parent_id"))
    head = results.account_document(o, c, "account_id").withColumns({"platform": F.lit("facebook"), "extracted_at": F.lit("2024-02-01T12:00:00")})
    base = _path(s, "accounts")
    documents.account_files(head, c, "account_id", base, F.lit("2024-02-01").cast("date"), ["id"])
    kind = "account_id string, meta struct<posts_processed: long>, total_comments long, stats struct<replies: long, expected_comments: long, extraction_ratio: double>, comments array<struct<likes: long>>"
    back = s.read.json(f"{base}/*/latest.json", multiLine=True, schema=kind)
    return back.select("account_id", F.col("meta.posts_processed").alias("posts"), F.col("total_comments").alias("comments"), F.size("comments").cast("long").alias("listed"), "stats.replies", F.col("stats.expected_comments").alias("expected"), F.col("stats.extraction_ratio").alias("ratio"), F.aggregate("comments.likes", F.lit(0).cast("long"), lambda x, y: x + y).alias("likes"))


@register("versioned_rows", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def _(s, d):
    """The second of two writes, after one that died before its switch was rolled back."""
    lines = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"))
    at = _path(s, "versions")
    table = tables.VersionedTable(s, at)
    table.write(lines.where("l_returnflag = 'R'"))

    def dies(step):
        if step == "verified":
            raise InterruptedError(step)

    try:
        tables.VersionedTable(s, at, dies).write(lines.where("l_returnflag = 'A'"))
    except InterruptedError:
        table.recover()
    table.write(lines)
    return table.read()


@register("mask_nested", """
    WITH e AS (SELECT event_id, CASE WHEN length(event_type) <= 3 THEN repeat('*', length(event_type)) ELSE left(event_type, 3) || '***' END AS masked, event_type, (props::JSON->>'$.k')::BIGINT AS k FROM events)
    SELECT event_id, '{"Password":"' || masked || '","a":{"a":{"a":{"a":{"a":{"token":"' || event_type || '"},"token":"' || masked || '"}}}},"inner":{"list":[{"apikey":"' || masked || '","private":' || k || '},"' || event_type || '",[{"secret":"' || event_type || '"}]],"name":"' || event_type || '"},"props":{"k":' || k || '}}' AS value FROM e""")
def _(s, d):
    e = a.table(s, d, "events")
    kind, q = F.col("event_type"), F.lit
    k = F.get_json_object("props", "$.k")
    deep = F.concat(q('{"a":{"a":{"a":{"a":{"token":"'), kind, q('","a":{"token":"'), kind, q('"}}}}}}'))
    text = F.concat(q('{"props":'), F.col("props"), q(',"inner":{"name":"'), kind, q('","list":[{"apikey":"'), kind, q('","private":'), k, q('},"'), kind, q('",[{"secret":"'), kind, q('"}]]},"a":'), F.expr("substring(deep, 6, length(deep) - 6)"), q(',"Password":"'), kind, q('"}'))
    return e.withColumn("deep", deep).select("event_id", safety.mask_json(text).alias("value"))
