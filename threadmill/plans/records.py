"""Queries on captured files, checkpoints, authors, runs and text fields, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmill.functions import counts, dates, safety
from threadmill.functions import text as tx
from threadmill.operators import documents, export, ingest, metrics, similarity, threads, validate
from threadmill.plans.core import ACTIVITY, COMMENTS, register
from threadmill.session import shared_path
from threadmill.sources import adapters as a
from threadmill.sources import files
from threadmill.streaming import events


def _path(s, name):
    return shared_path(s, f"{name}-{uuid.uuid4().hex}")


@register("extraction_health", """
    WITH u AS (SELECT user_id, count(*) AS containers, count(*) FILTER (event_type = 'view' AND value > 90) AS comments, count(*) FILTER (value > 20) / count(*) AS text_rate, count(*) FILTER (event_type = 'click') / count(*) AS author_rate FROM events GROUP BY 1)
    SELECT user_id, list_filter([CASE WHEN containers > 5 AND comments = 0 THEN 'no comments' END, CASE WHEN containers > 10 AND comments < containers * 0.1 THEN 'few comments' END, CASE WHEN text_rate < 0.5 THEN 'few texts' END, CASE WHEN author_rate < 0.3 THEN 'few authors' END], lambda x: x IS NOT NULL) AS alerts FROM u""")
def _(s, d):
    share = lambda c: F.count_if(c) / F.count("*")
    u = a.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("containers"), F.count_if((F.col("event_type") == "view") & (F.col("value") > 90)).alias("comments"), share(F.col("value") > 20).alias("text_rate"), share(F.col("event_type") == "click").alias("author_rate"))
    return validate.health(u).select("user_id", "alerts")


@register("masked_logs", """SELECT c_custkey, 'login of ' || c_custkey || ' password=' || left(c_name, 3) || '***, Token: "' || left(c_mktsegment, 3) || '***" api_key=*** done' AS line FROM customer""")
def _(s, d):
    line = F.concat(F.lit("login of "), F.col("c_custkey").cast("string"), F.lit(" password="), F.col("c_name"), F.lit(', Token: "'), F.col("c_mktsegment"), F.lit('" api_key=ab done'))
    return a.table(s, d, "customer").select("c_custkey", safety.mask_log(line).alias("line"))


@register("usernames", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'user.' || c_custkey WHEN 1 THEN 'únë_' || c_custkey WHEN 2 THEN NULL ELSE NULL END AS username FROM customer")
def _(s, d):
    c, k = a.table(s, d, "customer"), F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("  @user."), k, F.lit("\t"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("únë_"), k)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("two words "), k)).otherwise(F.concat(F.lit("@@"), k))
    return c.select("c_custkey", tx.extract_username(raw).alias("username"))


@register("first_numbers", "SELECT doc_id, coalesce(try_cast(regexp_extract(text, '([0-9]+)', 1) AS BIGINT), 1) AS n FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", counts.first_number(F.col("text")).alias("n"))


@register("ratings", "SELECT l_orderkey, l_linenumber, (l_quantity::INT || '.5')::DOUBLE AS rating, repeat('$', (l_linenumber % 4)::INT) AS level FROM lineitem WHERE l_linenumber % 4 > 0 UNION ALL SELECT l_orderkey, l_linenumber, (l_quantity::INT || '.5')::DOUBLE, NULL FROM lineitem WHERE l_linenumber % 4 = 0")
def _(s, d):
    i = a.table(s, d, "lineitem")
    said = F.concat(F.lit("rated "), F.col("l_quantity").cast("int").cast("string"), F.lit(",5 stars · "), F.repeat(F.lit("$"), F.col("l_linenumber").cast("int") % 4))
    return i.select("l_orderkey", "l_linenumber", counts.rating(said).alias("rating"), counts.price_level(said).alias("level"))


@register("comments_cleaned", r"SELECT doc_id, md5(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", F.md5(tx.clean_comment(F.concat(F.lit("\u2003 "), F.chr(F.lit(0)), F.col("text"), F.lit("\t\n")))).alias("digest"))


@register("run_durations", "SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN (o_custkey % 977) + 0.5 END::DOUBLE AS seconds FROM orders")
def _(s, d):
    o = a.table(s, d, "orders").withColumn("started", F.col("o_orderdate").cast("timestamp"))
    done = F.when(F.col("o_custkey") % 5 > 0, F.timestamp_micros(F.unix_micros("started") + (F.col("o_custkey") % 977) * 1_000_000 + 500_000))
    return o.select("o_orderkey", dates.duration(F.col("started"), done).alias("seconds"))


@register("runs_retained", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR")
def _(s, d):
    """To the second, as runs are kept."""
    e = a.table(s, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp") + F.expr("INTERVAL 999999 MICROSECONDS")).alias("started_at"))
    return metrics.retained(e, F.lit("2024-01-20 12:00:00").cast("timestamp")).select("event_id")


@register("exports_beyond_age", "SELECT o_orderkey FROM orders WHERE o_orderdate::TIMESTAMP < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY")
def _(s, d):
    held = a.table(s, d, "orders").select("o_orderkey", F.concat(F.lit("/x/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"))
    return export.older_than(held, F.lit("1998-01-01 00:00:00").cast("timestamp"), 30).select("o_orderkey")


@register("cache_hit_rates", "SELECT user_id, round(CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0 THEN count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'click')) ELSE 0 END, 6)::DOUBLE AS rate FROM events GROUP BY 1")
def _(s, d):
    e = a.table(s, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"))
    return e.select("user_id", F.round(metrics.hit_rate(F.col("hits"), F.col("misses")), 6).alias("rate"))


@register("authors_coalesced", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS display_name, CASE c_custkey % 3 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 'u' || c_custkey END AS profile_url FROM customer")
def _(s, d):
    c, k = a.table(s, d, "customer"), F.col("c_custkey")
    text = k.cast("string")
    made = ingest.author({"name": F.when(k % 2 == 0, F.col("c_name")).otherwise(""), "full_name": F.col("c_mktsegment"), "profile_url": F.when(k % 3 == 0, F.concat(F.lit("p"), text)), "url": F.when(k % 3 == 1, F.concat(F.lit("u"), text)).otherwise("")})
    return c.select("c_custkey", made.alias("x")).select("c_custkey", "x.display_name", "x.profile_url")


@register("history_upserted", """
    WITH h AS (SELECT o_orderstatus AS client, o_orderpriority AS platform, o_custkey AS account_id, max(o_orderdate) AS last_post_date, count(*) AS posts_scraped FROM orders GROUP BY ALL),
    n AS (SELECT o_orderstatus AS client, o_orderpriority AS platform, o_custkey AS account_id, max(o_orderdate) AS last_post_date, count(*) AS posts_scraped FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL)
    SELECT client, platform, account_id, coalesce(n.last_post_date, h.last_post_date) AS last_post_date, coalesce(n.posts_scraped, h.posts_scraped) AS posts_scraped, n.client IS NOT NULL AS changed FROM h LEFT JOIN n USING (client, platform, account_id)""")
def _(s, d):
    p = a.table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("client"), F.col("o_orderpriority").alias("platform"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("published_at"))
    at = lambda x: F.lit(x).cast("timestamp")
    none = s.createDataFrame([], "client string, platform string, account_id long, last_post_date date, posts_scraped long, completed_at timestamp").select("client", "platform", F.col("account_id").cast(p.schema["account_id"].dataType), F.col("last_post_date").cast(p.schema["published_at"].dataType), "posts_scraped", "completed_at")
    first = ingest.history(none, p, at("2024-02-01 00:00:00"))
    later = ingest.history(first, p.where("o_orderkey % 4 = 0"), at("2024-02-02 00:00:00"))
    return later.select("client", "platform", "account_id", "last_post_date", "posts_scraped", (F.col("completed_at") == at("2024-02-02 00:00:00")).alias("changed"))


@register("unprocessed_posts", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    """A checkpoint file of a run is written, read back and anti-joined."""
    done = a.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.to_json(F.array(F.col("l_orderkey").cast("string"))).alias("value")).distinct()
    at = _path(s, "checkpoint")
    done.select(F.concat(F.lit('{"processed_post_ids":'), F.col("value"), F.lit("}")).alias("value")).write.option("lineSep", "\n").text(at)
    ids = s.read.text(at).select(F.explode(F.from_json("value", "processed_post_ids array<string>")["processed_post_ids"]).alias("id")).distinct()
    return a.table(s, d, "orders").join(ids, F.col("o_orderkey").cast("string") == F.col("id"), "left_anti").select("o_orderkey")


def _captured(s, d):
    """Comments of every client and platform in JSON files of their own, and the folder that holds these."""
    c = a.comments(s, d).select("client", "platform", F.col("platform").alias("account"), F.col("platform_id").alias("id"), "post_id", "likes")
    base = _path(s, "captured")
    documents.company_files(c, ("client", "platform", "account"), "comments", base, F.lit("2024-02-01 03:04:05").cast("timestamp"), ["id"])
    return base


@register("captured_comments", f"SELECT platform_id AS id, post_id, likes FROM {COMMENTS}")
def _(s, d):
    return files.json_records(s, f"{_captured(s, d)}/*/*/*.json", "comments").select("id", "post_id", F.col("likes").cast("long").alias("likes"))


@register("known_ids_of_files", f"SELECT DISTINCT platform_id AS id FROM {COMMENTS}")
def _(s, d):
    return files.known_ids(s, f"{_captured(s, d)}/*/*/*.json", "comments")


@register("listed_exports", f"SELECT DISTINCT client || '/en/en_comments_20240201_030405.json' AS file FROM {COMMENTS} WHERE platform = 'en'")
def _(s, d):
    base = _captured(s, d)
    return files.exports(s, base, platform="en", fmt="json").select(F.regexp_extract("path", "([^/]+/[^/]+/[^/]+)$", 1).alias("file"))


@register("latest_files", f"SELECT client, max(platform) || '_comments_20240201_030405.json' AS file FROM {COMMENTS} GROUP BY 1")
def _(s, d):
    held = files.listing(s, _captured(s, d)).withColumn("client", F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1))
    return files.latest(held, "path", "client").select("client", F.regexp_extract("path", "([^/]+)$", 1).alias("file"))


@register("page_links", """
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://www.facebook.com/page' || c_nationkey || '/posts/' || c_custkey WHEN 1 THEN 'https://www.facebook.com/Page' || c_nationkey || '/posts/' || c_custkey END AS url FROM customer WHERE c_custkey % 5 IN (0, 1)""")
def _(s, d):
    """Links of a page's own posts, made absolute; those of groups, events and other pages go."""
    c, key = a.table(s, d, "customer"), F.col("c_custkey").cast("string")
    page, k = F.concat(F.lit("page"), F.col("c_nationkey").cast("string")), F.col("c_custkey") % 5
    tail = F.concat(F.lit("/posts/"), key)
    href = F.when(k == 0, F.concat(F.lit("/"), page, tail)).when(k == 1, F.concat(F.lit("https://www.facebook.com/P"), F.substring(page, 2, 99), tail)).when(k == 2, F.concat(F.lit("/groups/"), page, tail)).when(k == 3, F.concat(F.lit("/other"), tail)).otherwise(F.concat(F.lit("/events/"), page, F.lit("/"), key))
    return c.where(safety.url_in_scope(href, page)).select("c_custkey", safety.absolute_url(href).alias("url"))


_KEYS = {"facebook": "concat_ws(':', role, left(text, 50))", "instagram": r"left(trim(regexp_replace(text, '^@[\p{L}\p{N}_.]+', '')), 100)", "twitter": "text", "google": "concat_ws(':', role, text, (turn % 5)::VARCHAR)"}


@register("dedupe_first_platforms", " UNION ALL ".join(f"SELECT '{p}' AS platform, conv_id AS post_id, turn AS idx FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, {key} ORDER BY turn) = 1" for p, key in _KEYS.items()))
def _(s, d):
    c = a.table(s, d, "conversations").select(F.col("conv_id").alias("post_id"), F.col("turn").alias("idx"), "text", F.col("role").alias("author"), F.col("role").alias("reviewer_name"), (F.col("turn") % 5).cast("string").alias("rating"))
    made = [threads.first_of(c, threads.SAME[p]()).select(F.lit(p).alias("platform"), "post_id", "idx") for p in _KEYS]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


@register("thread_context", """
    SELECT conv_id AS post_id, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS position, md5(lag(c.text) OVER (PARTITION BY conv_id, role ORDER BY turn)) AS previous, md5(d.text) AS post_text, d.source AS post_type
    FROM conversations c LEFT JOIN documents d ON d.doc_id = conv_id AND doc_id % 3 > 0""")
def _(s, d):
    p = a.table(s, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("post_id"), "text", F.col("source").alias("media_type"))
    c = threads.with_context(a.threaded(s, d), p)
    return c.select("post_id", "idx", "position", F.md5("previous").alias("previous"), F.md5("post_text").alias("post_text"), "post_type")


@register("run_routes", "SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'success' WHEN 1 THEN 'info' WHEN 2 THEN 'success' WHEN 3 THEN 'warning' WHEN 4 THEN 'warning' WHEN 5 THEN 'warning' ELSE 'error' END AS level, CASE event_id % 12 WHEN 0 THEN 'Extraction Completed' WHEN 1 THEN 'Login Successful' WHEN 2 THEN 'Data Exported' WHEN 3 THEN 'Rate Limit Warning' WHEN 4 THEN 'Rate Limit Detected' WHEN 5 THEN 'Warning' WHEN 6 THEN 'Extraction Failed' WHEN 7 THEN 'Login Failed' WHEN 8 THEN 'Error Occurred' END AS title FROM events WHERE event_id % 12 < 9")
def _(s, d):
    """All nine kinds, and three that nobody announces."""
    kinds = [*[r[0] for r in events.RUN_ROUTES], "extraction.started", "post.extracted", "progress.update"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 12 + 1).cast("int"))
    return events.route(a.table(s, d, "events").select("event_id", kind.alias("event_type")), events.RUN_ROUTES).select("event_id", "level", "title")


@register("group_peaks", f"SELECT platform, k::INTEGER AS rank, day, n FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, day) AS k FROM (SELECT platform, published_at::DATE AS day, count(*) AS n FROM {ACTIVITY} GROUP BY ALL)) WHERE k <= 3")
def _(s, d):
    return similarity.group_peaks(a.activity(s, d), "platform")


@register("session_rates", "SELECT user_id, round(CASE WHEN sum(value) > 0 THEN count(*) FILTER (event_type = 'view') / sum(value) ELSE 0 END * 60, 6) AS posts_per_minute, round(CASE WHEN sum(value) > 0 THEN count(*) FILTER (event_type = 'click') / sum(value) ELSE 0 END * 60, 6) AS comments_per_minute, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1")
def _(s, d):
    one = lambda kind: (F.col("event_type") == kind).cast("int")
    e = a.table(s, d, "events").select("user_id", one("view").alias("posts"), one("click").alias("comments"), one("error").alias("errors"), F.lit(1).alias("requests"), F.col("value").alias("seconds"))
    return metrics.session_rates(e, "user_id").select("user_id", *[F.round(c, 6).alias(c) for c in ("posts_per_minute", "comments_per_minute", "error_rate")])


@register("platform_list_errors", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['platforms not unique'] WHEN 2 THEN ['unknown platform'] WHEN 3 THEN ['no platforms'] ELSE ['unknown platform', 'platforms not unique'] END AS errors FROM customer")
def _(s, d):
    c, k = a.table(s, d, "customer"), F.col("c_custkey") % 5
    asked = F.when(k == 0, F.array(F.lit("facebook"), F.lit("google"))).when(k == 1, F.array(F.lit("google"), F.lit("google"))).when(k == 2, F.array(F.col("c_mktsegment"))).when(k == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("x")))
    return c.select("c_custkey", validate.list_errors(asked, ("facebook", "instagram", "twitter", "linkedin", "google")).alias("errors"))
