"""Queries on saved results, validation of whole results, run bookkeeping, searches and exports, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import counts
from threadmill.functions import text as tx
from threadmill.operators import commenters, export, query, results, runs, similarity, store, threads, validate
from threadmill.plans.core import ACTIVITY, COMMENTS, THREADS, register
from threadmill.sources import adapters as a

NOW = "2024-02-01 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


POSTS = "(SELECT o_orderkey AS platform_id, o_custkey AS account_id, o_orderstatus AS platform, o_orderdate AS published_at, o_totalprice AS likes, o_custkey % 9 AS comments_count FROM orders)"


def _posts(s, d):
    return a.posts(s, d).withColumn("comments_count", F.col("account_id") % 9)


@register("saved_parts", f"SELECT client, platform, 'comments' AS kind, count(*) AS rows FROM {COMMENTS} GROUP BY ALL UNION ALL SELECT client, platform, 'posts', count(DISTINCT post_id) FROM {COMMENTS} GROUP BY ALL")
def _(s, d):
    c = a.comments(s, d)
    return results.parts(["client", "platform"], posts=c.select("client", "platform", "post_id").distinct(), comments=c)


@register("company_documents", f"""
    SELECT client, platform, kind, total, '{{"client":"' || client || '","platform":"' || platform || '","kind":"' || kind || '","total":' || total || ',"extracted_at":"2024-02-01T12:00:00"}}' AS metadata
    FROM (SELECT client, platform, 'comments' AS kind, count(*) AS total FROM {COMMENTS} GROUP BY ALL UNION ALL SELECT client, platform, 'posts', count(DISTINCT post_id) FROM {COMMENTS} GROUP BY ALL)""")
def _(s, d):
    c = a.comments(s, d)
    return results.company_documents(c.select("client", "platform", "post_id").distinct(), c, ["client", "platform"], _now())


@register("author_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name END AS name FROM customer")
def _(s, d):
    c = a.table(s, d, "customer")
    user = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 2, F.col("c_name"))
    return c.select("c_custkey", results.author_name(user, F.col("c_mktsegment")).alias("name"))


@register("account_document", f"""
    WITH p AS (SELECT account_id, count(*) AS posts_processed, sum(comments_count)::BIGINT AS expected_comments FROM {POSTS} GROUP BY 1),
    c AS (SELECT o_custkey AS account_id, count(*) AS total_comments, count(*) FILTER (l_linenumber > 1) AS replies FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT account_id, '2.0' AS version, posts_processed, coalesce(total_comments, 0) AS total_comments, coalesce(total_comments - replies, 0) AS top_level_comments, coalesce(replies, 0) AS replies, expected_comments,
           CASE WHEN expected_comments > 0 THEN round_even(coalesce(total_comments, 0) / expected_comments, 2) ELSE 0 END AS extraction_ratio FROM p LEFT JOIN c USING (account_id)""")
def _(s, d):
    p = _posts(s, d)
    c = a.post_comments(s, d).join(p.select(F.col("platform_id").alias("post_id"), "account_id"), "post_id").withColumn("parent_id", F.when(F.col("idx") > 1, F.col("post_id")))
    return results.account_document(p, c, "account_id")


@register("api_comments", f"SELECT platform_id, post_id, platform, coalesce(CASE WHEN seq % 2 = 0 THEN client END, '') AS author_username, client AS author_display_name, md5(text) AS text, likes, CASE WHEN seq % 3 = 0 THEN post_id END AS parent_id FROM {COMMENTS}")
def _(s, d):
    c = a.comments(s, d).withColumns({"author_username": F.when(F.col("seq") % 2 == 0, F.col("client")), "author_display_name": F.col("client"), "published_at": F.lit(None).cast("timestamp"), "parent_id": F.when(F.col("seq") % 3 == 0, F.col("post_id"))})
    return results.api_comments(c).drop("published_at").withColumn("text", F.md5("text"))


@register("api_posts", f"SELECT platform_id, platform, account_id, 'u' || platform_id AS url, platform AS text, likes, comments_count, account_id % 4 AS shares, published_at, 'photo' AS media_type FROM {POSTS}")
def _(s, d):
    return results.api_posts(_posts(s, d).withColumns({"url": F.concat(F.lit("u"), "platform_id"), "text": F.col("platform"), "shares": F.col("account_id") % 4, "media_type": F.lit("photo")}))


@register("analyser_objects", r"""
    SELECT conv_id, turn, turn AS likes, CASE WHEN role <> 'user' THEN true ELSE false END AS is_reply, CASE WHEN role <> 'user' THEN conv_id::VARCHAR END AS parent_id,
           regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1) AS hashtags FROM conversations""")
def _(s, d):
    c = a.table(s, d, "conversations")
    given = c.select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("platform_id"), F.lit("facebook").alias("platform"), F.col("conv_id").alias("post_id"), F.struct("role").alias("author"), _now().alias("published_at"), F.col("turn").alias("likes"), F.lit(0).alias("replies_count"), F.when(F.col("role") != "user", F.col("conv_id").cast("string")).alias("parent_id"), F.lit("post").alias("post_text"), F.lit("photo").alias("post_type"), F.lit("fr").alias("language"))
    made = results.analyser_object(given, tx.mentions(F.col("text")), tx.hashtags(F.col("text")))
    turn = F.split("id", "-")
    return made.select(F.col("post_id").alias("conv_id"), turn[1].cast("long").alias("turn"), "engagement.likes", "context.is_reply", "context.parent_id", "metadata.hashtags")


@register("journal_lines", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'START|' || c_custkey || '|2024-02-01T12:00:00' WHEN 1 THEN 'COMMIT|' || c_custkey || '|' || md5(c_name) || '|/data/' || c_custkey ELSE 'ROLLBACK|' || c_custkey || '|' || c_mktsegment END AS value FROM customer")
def _(s, d):
    c, key = a.table(s, d, "customer"), F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, results.journal_line(F.lit("START"), key, F.date_format(_now(), "yyyy-MM-dd'T'HH:mm:ss")))
    line = line.when(F.col("c_custkey") % 3 == 1, results.journal_line(F.lit("COMMIT"), key, F.md5("c_name"), F.concat(F.lit("/data/"), key))).otherwise(results.journal_line(F.lit("ROLLBACK"), key, F.col("c_mktsegment")))
    return c.select("c_custkey", line.alias("value"))


@register("content_digest", "SELECT count(*) AS rows, sum(('0x' || left(md5('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}'), 12))::BIGINT % 1000003)::BIGINT AS digest FROM customer")
def _(s, d):
    return results.content_digest(a.table(s, d, "customer").select("c_name", "c_custkey"))


@register("log_operations", "SELECT user_id::VARCHAR AS correlation_id, count(*) AS lines, count(*) FILTER (event_type = 'error') AS errors, max(value) FILTER (event_type = 'click') AS duration_ms, max(date_trunc('second', ts)) AS last FROM events GROUP BY 1")
def _(s, d):
    e = a.table(s, d, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    extra = F.when(F.col("event_type") == "click", F.create_map(F.lit("duration_ms"), F.col("value").cast("string")))
    lines = e.select(F.to_json(F.struct(level.alias("level"), F.lit("x").alias("logger"), F.col("event_type").alias("message"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("correlation_id"), extra.alias("extra"))).alias("value"))
    return results.log_operations(results.parse_logs(lines)).drop("first")


@register("companies_of_country", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(s, d):
    return a.table(s, d, "customer").where(query.same_word(F.col("c_mktsegment"), "Building")).select("c_custkey")


@register("first_posts_with_comments", f"SELECT platform_id, comments_count FROM {POSTS} WHERE comments_count >= 5 ORDER BY platform_id LIMIT 40")
def _(s, d):
    return query.with_comments(_posts(s, d), 5, 40, "platform_id").select("platform_id", "comments_count")


@register("comment_text_or_label", r"""
    SELECT l_orderkey, l_linenumber, NOT (lower(t) IN ('like', 'reply') OR regexp_matches(t, '(?i)^[0-9]+\s*(like|reply)s?$') OR regexp_matches(t, '^[0-9]+[hdwms]?$') OR regexp_matches(t, '(?i)^View\s+(all)?')) AS is_text
    FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN 'Reply' WHEN 1 THEN l_suppkey || ' Likes' WHEN 2 THEN l_suppkey || 'w' WHEN 3 THEN 'View all ' || l_suppkey ELSE 'like ' || l_returnflag END AS t FROM lineitem)""")
def _(s, d):
    k, n = F.col("l_linenumber") % 6, F.col("l_suppkey").cast("string")
    t = F.when(k == 0, "Reply").when(k == 1, F.concat(n, F.lit(" Likes"))).when(k == 2, F.concat(n, F.lit("w"))).when(k == 3, F.concat(F.lit("View all "), n)).otherwise(F.concat(F.lit("like "), "l_returnflag"))
    return a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", query.not_button_text(t).alias("is_text"))


@register("comment_search", f"SELECT seq FROM {COMMENTS} WHERE platform = 'en' AND contains(lower(text), 'ing of')")
def _(s, d):
    return query.search(a.comments(s, d), platform="en", text="ING of").select("seq")


@register("author_search", f"SELECT seq FROM {ACTIVITY} WHERE author_id = 8 AND published_at >= TIMESTAMP '2024-01-03 00:00:00'")
def _(s, d):
    return query.search(a.activity(s, d), since=F.lit("2024-01-03 00:00:00").cast("timestamp"), author=8).select("seq")


@register("word_search", rf"""
    WITH w AS (SELECT DISTINCT seq, unnest(string_split_regex(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+')) AS word FROM {COMMENTS})
    SELECT seq FROM w WHERE word IN ('reaux', 'la') GROUP BY 1 HAVING count(*) = 2""")
def _(s, d):
    return query.having_words(query.word_index(a.comments(s, d)), ["Réaux", "la"])


@register("last_extraction", "SELECT q.client, q.platform, q.account_id, max(o_orderdate) AS last_post_date FROM (SELECT DISTINCT o_orderstatus AS client, o_orderpriority AS platform, o_custkey + 1 AS account_id FROM orders) q LEFT JOIN orders ON o_orderstatus = client AND o_orderpriority = platform AND o_custkey = account_id GROUP BY ALL")
def _(s, d):
    h = a.table(s, d, "orders").select(F.col("o_orderstatus").alias("client"), F.col("o_orderpriority").alias("platform"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").alias("last_post_date"))
    return runs.last_extraction(h, h.withColumn("account_id", F.col("account_id") + 1).select("client", "platform", "account_id").distinct())


@register("monitor_summary", """
    WITH g AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS posts, coalesce(sum(floor(value)) FILTER (event_type <> 'error'), 0)::BIGINT AS comments, count(*) FILTER (event_type = 'error') AS errors, epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT AS duration_seconds FROM events GROUP BY 1)
    SELECT *, round(CASE WHEN duration_seconds > 0 AND posts > 0 THEN posts / duration_seconds * 60 ELSE 0 END, 6) AS extraction_rate, round(CASE WHEN duration_seconds > 0 AND posts > 0 THEN comments / posts ELSE 0 END, 6) AS avg_comments_per_post FROM g""")
def _(s, d):
    e = a.table(s, d, "events").select("user_id", F.col("ts").alias("published_at"), F.floor("value").alias("comments"), (F.col("event_type") == "error").alias("failed"))
    return runs.monitor(e, "user_id").withColumns({c: F.round(c, 6) for c in ("extraction_rate", "avg_comments_per_post")})


RUNS = "(SELECT o_orderkey, o_orderstatus AS client, o_orderkey % 600 AS duration, o_custkey % 5 AS posts, o_custkey % 40 AS comments, (o_custkey % 7 = 0)::INT AS errors, (o_custkey % 11 = 0)::INT AS rate_limits FROM orders)"


def _runs(s, d):
    o = a.table(s, d, "orders")
    k = F.col("o_custkey")
    return o.select("o_orderkey", F.col("o_orderstatus").alias("client"), (F.col("o_orderkey") % 600).alias("duration"), (k % 5).alias("posts"), (k % 40).alias("comments"), (k % 7 == 0).cast("int").alias("errors"), (k % 11 == 0).cast("int").alias("rate_limits"))


@register("record_run", f"SELECT count(*) AS total_extractions, sum(posts)::BIGINT AS total_posts, sum(comments)::BIGINT AS total_comments, sum(errors)::BIGINT AS total_errors, sum(rate_limits)::BIGINT AS total_rate_limits FROM {RUNS}")
def _(s, d):
    return runs.recorded(_runs(s, d))


@register("run_histograms", f"""
    SELECT 'extraction_duration' AS name, (duration >= 60)::INT + (duration >= 300)::INT AS bucket, count(*) AS n FROM {RUNS} GROUP BY ALL
    UNION ALL SELECT 'posts_per_extraction', (posts >= 1)::INT + (posts >= 3)::INT, count(*) FROM {RUNS} WHERE posts > 0 GROUP BY ALL
    UNION ALL SELECT 'comments_per_extraction', (comments >= 10)::INT, count(*) FROM {RUNS} WHERE comments > 0 GROUP BY ALL""")
def _(s, d):
    return runs.histograms(_runs(s, d), {"extraction_duration": [60, 300], "posts_per_extraction": [1, 3], "comments_per_extraction": [10]})


@register("eta_by_client", f"""
    SELECT client, count(*) AS done, CASE WHEN e < 60 THEN e || 's' WHEN e < 3600 THEN e // 60 || 'm ' || e % 60 || 's' ELSE e // 3600 || 'h ' || e % 3600 // 60 || 'm' END AS eta
    FROM (SELECT client, duration, floor(avg(duration) OVER w * (200000 - count(*) OVER w))::BIGINT AS e FROM {RUNS} WINDOW w AS (PARTITION BY client)) GROUP BY client, e""")
def _(s, d):
    return runs.eta(_runs(s, d), 200_000, "client")


@register("extract_all", """
    SELECT c_custkey AS account_id, CASE WHEN n IS NULL OR c_custkey % 5 = 0 THEN 0 ELSE n END AS posts, CASE WHEN n IS NULL OR c_custkey % 5 = 0 THEN 0 ELSE k END AS comments, CASE WHEN n IS NULL THEN 'no result' WHEN c_custkey % 5 = 0 THEN 'timeout' END AS error
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 10)::BIGINT AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0""")
def _(s, d):
    accounts = a.table(s, d, "customer").select(F.col("c_custkey").alias("account_id"), (F.col("c_custkey") % 4 != 0).alias("enabled"))
    done = a.table(s, d, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.count("*").alias("posts"), F.sum(F.col("o_orderkey") % 10).alias("comments")).withColumn("error", F.when(F.col("account_id") % 5 == 0, "timeout"))
    return runs.extract_all(accounts, done)


@register("extraction_statistics", """
    WITH c AS (SELECT o_orderstatus AS platform, l_suppkey AS author_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    p AS (SELECT o_orderstatus AS platform, count(*) AS posts, min(o_orderdate) AS earliest_post, max(o_orderdate) AS latest_post FROM orders GROUP BY 1)
    SELECT p.platform, posts, comments, unique_authors, earliest_post, latest_post FROM p JOIN (SELECT platform, count(*) AS comments, count(DISTINCT author_id) AS unique_authors FROM c GROUP BY 1) x USING (platform)
    UNION ALL SELECT NULL, (SELECT count(*) FROM orders), count(*), count(DISTINCT author_id), (SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders) FROM c""")
def _(s, d):
    p = _posts(s, d)
    return runs.statistics(p, a.post_comments(s, d).join(p.select(F.col("platform_id").alias("post_id"), "platform"), "post_id"))


@register("topic_counts", "SELECT topic, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([source, lang, CASE WHEN n_chars > 500 THEN 'long' ELSE lang END]) AS topic FROM documents) WHERE topic IS NOT NULL GROUP BY 1")
def _(s, d):
    long = F.when(F.col("n_chars") > 500, "long").otherwise(F.col("lang"))
    return runs.topic_counts(a.table(s, d, "documents"), F.array_compact(F.array("source", "lang", long)))


@register("newest_text_dates", f"SELECT seq, t FROM (SELECT seq, CASE WHEN seq % 10 <> 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') END AS t FROM {ACTIVITY}) ORDER BY coalesce(t, '') DESC, seq LIMIT 30")
def _(s, d):
    e = a.activity(s, d).select("seq", F.when(F.col("seq") % 10 != 0, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("t"))
    return e.orderBy(query.newest_text_first("t"), "seq").limit(30)


@register("until_known_batches", f"""
    WITH b AS (SELECT author_id, seq // 500 AS batch, count(*) FILTER (platform IN ('view', 'click')) >= count(*) * 0.6 AS failed FROM {ACTIVITY} GROUP BY ALL),
    i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY author_id ORDER BY batch) AS island FROM b),
    r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY author_id, island ORDER BY batch) AS run FROM i),
    f AS (SELECT author_id, min(batch) AS stop FROM r WHERE run >= 3 GROUP BY 1)
    SELECT seq FROM {ACTIVITY} LEFT JOIN f USING (author_id) WHERE stop IS NULL OR seq // 500 <= stop""")
def _(s, d):
    e = a.activity(s, d).withColumn("batch", F.floor(F.col("seq") / 500)).withColumn("known", F.col("platform").isin("view", "click"))
    return query.until_known_batches(e, "batch", "known", 0.6, 3, "author_id").select("seq")


def _verdicts(s, d):
    """Orders as results: a seventh without an account, some of the future; lines as comments, some empty, with negative likes or of other posts."""
    o = a.table(s, d, "orders")
    p = o.select(F.col("o_orderkey").alias("result_id"), F.col("o_orderkey").alias("platform_id"), F.col("o_orderstatus").alias("platform"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("account_id"), F.col("o_totalprice").alias("likes"), F.lit(0).alias("comments_count"), F.lit("u").alias("url"), F.lit("t").alias("text"), F.col("o_orderdate").alias("published_at"))
    c = a.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("seq"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("platform_id"), F.when(F.col("l_suppkey") % 10 == 0, F.col("l_orderkey") + 1).otherwise(F.col("l_orderkey")).alias("post_id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise("words").alias("text"), F.when(F.col("l_quantity") == 1, -1).otherwise(1).alias("likes"),
    )
    return validate.results(p, c, F.lit("1998-01-01").cast("timestamp"))


VERDICTS = """(
    WITH c AS (SELECT l_orderkey AS result_id, l_linenumber AS seq, CASE WHEN l_quantity = 1 THEN 'negative likes' END AS e1, CASE WHEN l_suppkey % 10 = 0 THEN 'Comment ' || l_orderkey || '-' || l_linenumber || ' has post_id ' || (l_orderkey + 1) || ' but belongs to post ' || l_orderkey END AS e2, CASE WHEN l_returnflag = 'A' THEN 'empty text' END AS w FROM lineitem),
    g AS (SELECT result_id, flatten(list(list_filter([e1, e2], lambda x: x IS NOT NULL) ORDER BY seq, list_filter([e1, e2], lambda x: x IS NOT NULL))) AS errors, list(w ORDER BY seq) FILTER (w IS NOT NULL) AS warnings FROM c GROUP BY 1)
    SELECT o_orderkey AS result_id, o_orderstatus AS platform, list_concat(CASE WHEN o_orderkey % 7 = 0 THEN ['missing account_id'] ELSE [] END, coalesce(errors, [])) AS errors,
           list_concat(CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN ['future published_at'] ELSE [] END, coalesce(warnings, [])) AS warnings FROM orders LEFT JOIN g ON result_id = o_orderkey)"""


@register("validate_results", f"SELECT result_id, errors, warnings, len(errors) = 0 AS is_valid FROM {VERDICTS}")
def _(s, d):
    return _verdicts(s, d).select("result_id", "errors", "warnings", "is_valid")


@register("valid_results", f"SELECT result_id FROM {VERDICTS} WHERE len(errors) = 0")
def _(s, d):
    return validate.valid_results(_verdicts(s, d)).select("result_id")


@register("validate_fail_fast", f"SELECT result_id FROM {VERDICTS} WHERE result_id < (SELECT min(result_id) FROM {VERDICTS} WHERE len(errors) > 0)")
def _(s, d):
    return validate.before_first_invalid(_verdicts(s, d), "result_id").select("result_id")


@register("batch_report", f"SELECT platform, count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(errors) > 0) AS invalid, round(count(*) FILTER (len(errors) = 0) / count(*), 6) AS valid_rate, list_slice(list_sort(list(DISTINCT errors[1]) FILTER (errors[1] IS NOT NULL)), 1, 100) AS messages FROM {VERDICTS} GROUP BY 1")
def _(s, d):
    o = a.table(s, d, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("platform"))
    return validate.batch_report(_verdicts(s, d).join(o, "result_id"), "platform").withColumn("valid_rate", F.round("valid_rate", 6))


LINES = "(SELECT o_orderstatus AS platform, l_orderkey || '-' || l_linenumber AS platform_id, CASE WHEN l_suppkey % 20 = 0 THEN -l_orderkey ELSE l_orderkey END AS post_id, CASE WHEN o_orderstatus = 'F' AND l_suppkey % 3 = 0 THEN '' ELSE 'a' || l_suppkey END AS author_username, CASE WHEN l_suppkey % 2 = 0 THEN l_shipdate END AS published_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _lines(s, d):
    """Lines as comments of their order's platform: some of unknown posts, without authors or times."""
    i, o = a.table(s, d, "lineitem"), a.table(s, d, "orders")
    k = F.col("l_suppkey")
    return i.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderstatus").alias("platform"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("platform_id"), F.when(k % 20 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("post_id"),
        F.when((F.col("o_orderstatus") == "F") & (k % 3 == 0), "").otherwise(F.concat(F.lit("a"), k)).alias("author_username"), F.when(k % 2 == 0, F.col("l_shipdate")).alias("published_at"),
    )


QUALITY = f"""
    q AS (SELECT platform, platform_id, published_at, comments_count * 4 AS comments_count, CASE WHEN platform_id % 4 <> 0 THEN 'x' END AS text FROM {POSTS}), l AS (SELECT * FROM {LINES}),
    comp AS (SELECT platform, avg((text IS NOT NULL)::INT) AS post_text_rate, avg((published_at IS NOT NULL)::INT) AS post_timestamp_rate FROM q GROUP BY 1),
    comc AS (SELECT platform, avg((author_username <> '')::INT) AS comment_author_rate, avg((published_at IS NOT NULL)::INT) AS comment_timestamp_rate FROM l GROUP BY 1),
    n AS (SELECT post_id, count(*) AS actual FROM l GROUP BY 1),
    cons AS (SELECT platform, count(*) AS posts, count(*) FILTER (coalesce(actual, 0) < comments_count * 0.5 AND comments_count > 10) AS short_posts FROM q LEFT JOIN n ON post_id = platform_id GROUP BY 1),
    orph AS (SELECT platform, count(*) FILTER (post_id < 0) AS orphan_comments FROM l GROUP BY 1),
    dups AS (SELECT platform, count(*) AS total_comments, count(DISTINCT platform_id) AS unique_comments FROM l GROUP BY 1),
    fresh AS (SELECT platform, min(published_at) AS oldest_post, max(published_at) AS newest_post, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(max(published_at)))::BIGINT) / 3600 AS age FROM q GROUP BY 1)"""


def _quality_posts(s, d):
    return _posts(s, d).withColumn("comments_count", F.col("comments_count") * 4).withColumn("text", F.when(F.col("platform_id") % 4 != 0, "x"))


_rates = ("post_text_rate", "post_timestamp_rate", "comment_author_rate", "comment_timestamp_rate")


@register("completeness", f"WITH {QUALITY} SELECT platform, {', '.join(f'round({c}, 6) AS {c}' for c in _rates)}, post_timestamp_rate > 0.9 AND comment_author_rate > 0.8 AS passed FROM comp JOIN comc USING (platform)")
def _(s, d):
    return validate.completeness(_quality_posts(s, d), _lines(s, d), "platform").withColumns({c: F.round(c, 6) for c in _rates})


@register("consistency", f"WITH {QUALITY} SELECT platform, orphan_comments, short_posts, posts, short_posts + (orphan_comments > 0)::INT AS issues, orphan_comments = 0 AND short_posts + (orphan_comments > 0)::INT <= posts * 0.1 AS passed FROM cons JOIN orph USING (platform)")
def _(s, d):
    return validate.consistency(_quality_posts(s, d), _lines(s, d), "platform")


@register("freshness", f"WITH {QUALITY} SELECT platform, oldest_post, newest_post, round(age, 4) AS data_age_hours, age < 168 AS passed FROM fresh")
def _(s, d):
    return validate.freshness(_quality_posts(s, d), _now(), "platform").withColumn("data_age_hours", F.round("data_age_hours", 4))


@register("repeated_ids", f"WITH {QUALITY} SELECT platform, total_comments, unique_comments, total_comments - unique_comments AS duplicates, round((total_comments - unique_comments) / total_comments, 6) AS duplicate_rate FROM dups")
def _(s, d):
    return validate.repeated_ids(_lines(s, d), "platform").withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@register("quality_score", f"""
    WITH {QUALITY} SELECT platform, round(CASE WHEN post_timestamp_rate > 0.9 AND comment_author_rate > 0.8 THEN 25 ELSE comment_author_rate * 25 END
        + CASE WHEN orphan_comments = 0 AND short_posts <= posts * 0.1 THEN 25 ELSE greatest(0, 25 - 2 * (short_posts + (orphan_comments > 0)::INT)) END + CASE WHEN age < 168 THEN 25 ELSE 0 END
        + 25 * unique_comments / total_comments, 1) AS score FROM comp JOIN comc USING (platform) JOIN cons USING (platform) JOIN orph USING (platform) JOIN dups USING (platform) JOIN fresh USING (platform)""")
def _(s, d):
    p, c = _quality_posts(s, d), _lines(s, d)
    j = validate.completeness(p, c, "platform").withColumnRenamed("passed", "complete").join(validate.consistency(p, c, "platform").withColumnRenamed("passed", "consistent"), "platform")
    j = j.join(validate.freshness(p, _now(), "platform").withColumnRenamed("passed", "fresh"), "platform").join(validate.repeated_ids(c, "platform"), "platform")
    col = F.col
    return j.select("platform", F.round(validate.combined_score(col("complete"), col("comment_author_rate"), col("consistent"), col("issues"), col("fresh"), col("duplicate_rate"), None), 1).alias("score"))


@register("export_json_document", """
    SELECT to_json({'metadata': {'client': 'acme', 'exported_at': '2024-02-01', 'format': 'json', 'version': '1.0', 'total_comments': count(*), 'platforms': list_sort(list(DISTINCT 'r' || n_regionkey)), 'stats': {'avg_likes': avg(n_nationkey::DOUBLE), 'total_replies': sum(n_nationkey % 3)::BIGINT}},
                    'comments': list({'id': n_nationkey, 'platform': 'r' || n_regionkey, 'text': n_name, 'likes': n_nationkey, 'replies_count': n_nationkey % 3} ORDER BY n_nationkey)})::VARCHAR AS value FROM nation""")
def _(s, d):
    c = a.table(s, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("platform"), F.col("n_name").alias("text"), F.col("n_nationkey").alias("likes"), (F.col("n_nationkey") % 3).alias("replies_count"))
    return export.json_document(c, export.Options(stats=True, indent=None), "acme", F.lit("2024-02-01"))


@register("export_jsonl_metadata", f"SELECT '{{\"type\":\"metadata\",\"client\":\"acme\",\"exported_at\":\"2024-02-01\",\"format\":\"jsonl\",\"version\":\"1.0\",\"total_comments\":' || count(*) || '}}' AS value FROM {COMMENTS}")
def _(s, d):
    return export.metadata_line(a.comments(s, d), "acme", F.lit("2024-02-01"))


@register("export_post_statistics", f"SELECT count(*) AS total, list_sort(list(DISTINCT platform)) AS platforms, round(avg(likes), 4) AS avg_likes, sum(comments_count)::BIGINT AS total_comments, sum(account_id % 4)::BIGINT AS total_shares FROM {POSTS}")
def _(s, d):
    return export.statistics(_posts(s, d).withColumn("shares", F.col("account_id") % 4)).withColumn("avg_likes", F.round("avg_likes", 4))


@register("export_csv_quoting", r"""
    SELECT kind, md5(value) AS digest FROM (
        SELECT 'needed' AS kind, conv_id || ',' || CASE WHEN regexp_matches(text, '[,"\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS value FROM conversations
        UNION ALL SELECT 'all', '"' || conv_id || '","' || replace(text, '"', '""') || '"' FROM conversations
        UNION ALL SELECT 'text', conv_id || ',"' || replace(text, '"', '""') || '"' FROM conversations)""")
def _(s, d):
    c = a.table(s, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    made = [export.csv_lines(c, export.Options(quoting=q)).select(F.lit(kind).alias("kind"), F.md5("value").alias("digest")) for kind, q in (("needed", 0), ("all", 1), ("text", 2))]
    return made[0].unionByName(made[1]).unionByName(made[2])


@register("export_ascii_json", "SELECT n_nationkey, '{\"t\":\"' || n_name || ' \\u00e9\\u6f22\\ud83d\\ude00\"}' AS value FROM nation")
def _(s, d):
    n = a.table(s, d, "nation")
    return n.select("n_nationkey", export.ascii_only(F.to_json(F.struct(F.concat("n_name", F.lit(" é漢😀")).alias("t")))).alias("value"))


_doc_words = r"(SELECT doc_id AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM documents)"


@register("jaccard_documents", f"""
    WITH s AS (SELECT min(id) AS id, w FROM {_doc_words} WHERE len(w) > 0 GROUP BY w), t AS (SELECT id, len(w) AS n, unnest(w) AS word FROM s),
    p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS k FROM t x JOIN t y ON x.word = y.word AND x.id < y.id GROUP BY ALL)
    SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM p WHERE k / (na + nb - k) >= 0.7""")
def _(s, d):
    c = a.table(s, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return similarity.jaccard_pairs(c, 0.7).withColumn("similarity", F.round("similarity", 6))


@register("cosine_neighbours", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT p.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(p.e, v.e), 6) AS similarity FROM v p JOIN v ON p.vec_id % 20 = 0 AND p.vec_id <> v.vec_id WHERE list_cosine_similarity(p.e, v.e) >= 0.3""")
def _(s, d):
    e = a.table(s, d, "embeddings")
    return similarity.similar_to(e, e.where("vec_id % 20 = 0"), 0.3)


@register("reply_ratios", f"SELECT post_id AS author_id, round(count(*) FILTER (is_reply) / count(*), 6) AS reply_ratio FROM {THREADS} GROUP BY 1")
def _(s, d):
    return commenters.reply_ratio(a.threaded(s, d).withColumn("author_id", F.col("post_id"))).withColumn("reply_ratio", F.round("reply_ratio", 6))


@register("influence_measured", f"""
    WITH p AS (SELECT author_id, avg(likes) AS avg_likes, count(*) AS n, count(*) FILTER (platform = 'click') / count(*) AS ratio, max(published_at) AS last_seen, max((platform = 'purchase')::INT) AS verified FROM {ACTIVITY} GROUP BY 1)
    SELECT author_id, round(round_even(20 * verified + least(avg_likes / 10 * 30, 30) + least(n / 20 * 20, 20) + least(ratio * 15, 15) + CASE WHEN date_diff('day', last_seen, TIMESTAMP '{NOW}') <= 30 THEN 15 WHEN date_diff('day', last_seen, TIMESTAMP '{NOW}') <= 90 THEN 7.5 ELSE 0 END, 2), 1) AS score FROM p""")
def _(s, d):
    e = a.activity(s, d).withColumn("is_reply", F.col("platform") == "click")
    verified = e.groupBy("author_id").agg(F.max(F.col("platform") == "purchase").alias("verified"))
    p = commenters.profiles(e).join(commenters.reply_ratio(e), "author_id").join(verified, "author_id")
    return p.select("author_id", F.round(commenters.influence(F.col("verified"), F.col("avg_likes"), F.col("total_comments"), F.col("reply_ratio"), F.datediff(F.to_date(_now()), F.col("last_seen"))), 1).alias("score"))


@register("verified_commenters", f"SELECT count(*) AS commenters, count(*) FILTER (v) AS verified FROM (SELECT author_id, bool_or(platform = 'purchase' AND likes > 50) AS v FROM {ACTIVITY} GROUP BY 1)")
def _(s, d):
    return commenters.verified_count(a.activity(s, d).withColumn("verified", (F.col("platform") == "purchase") & (F.col("likes") > 50)))


@register("activity_peaks", f"""
    WITH h AS (SELECT platform, hour(published_at) AS peak_hour, count(*) AS n, min((published_at, seq)) AS f FROM {ACTIVITY} GROUP BY ALL), w AS (SELECT platform, dayname(published_at) AS peak_weekday, count(*) AS n, min((published_at, seq)) AS f FROM {ACTIVITY} GROUP BY ALL),
    hh AS (SELECT platform, peak_hour, n AS peak_hour_count FROM h QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, f) = 1), ww AS (SELECT platform, peak_weekday, n AS peak_weekday_count FROM w QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, f) = 1)
    SELECT * FROM hh JOIN ww USING (platform)""")
def _(s, d):
    return commenters.peaks(a.activity(s, d), "platform")


@register("sentiment_by_day", f"SELECT platform, published_at::DATE::VARCHAR AS day, count(*) FILTER (likes > 60) AS positive, count(*) FILTER (likes < 20) AS negative, count(*) FILTER (likes BETWEEN 20 AND 60) AS neutral FROM {ACTIVITY} GROUP BY ALL")
def _(s, d):
    label = F.when(F.col("likes") > 60, "positive").when(F.col("likes") < 20, "negative").otherwise("neutral")
    return commenters.sentiment(a.activity(s, d).select("platform", F.date_format("published_at", "yyyy-MM-dd").alias("day"), label.alias("label")), "platform", "day")


@register("contact_sentiment", f"SELECT author_id, arg_min(likes, (published_at, seq)) AS first_score, arg_max(likes, (published_at, seq)) AS last_score, list_sort(list(DISTINCT platform)) AS topics FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    return commenters.contact_sentiment(a.activity(s, d).withColumn("score", F.col("likes")).withColumn("topics", F.array("platform")))


@register("journey_progression", f"SELECT author_id, row_number() OVER (PARTITION BY author_id ORDER BY published_at, seq) AS place, published_at, likes AS score FROM {ACTIVITY} WHERE likes > 0")
def _(s, d):
    return commenters.progression(a.activity(s, d).withColumn("score", F.col("likes")))


@register("group_details", rf"""
    WITH w AS (SELECT client, word, count(*) AS n FROM (SELECT client, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM {COMMENTS}) WHERE length(word) >= 3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY client ORDER BY n DESC, word) <= 5)
    SELECT c.client, unique_authors, keywords FROM (SELECT client, count(DISTINCT platform) AS unique_authors FROM {COMMENTS} GROUP BY 1) c JOIN (SELECT client, list(word ORDER BY n DESC, word) AS keywords FROM w GROUP BY 1) k ON c.client = k.client""")
def _(s, d):
    c = a.comments(s, d).withColumn("published_at", F.lit(None).cast("timestamp"))
    return similarity.group_details(c, "client", author="platform").select("client", "unique_authors", "keywords")


@register("group_dates", f"SELECT platform, count(DISTINCT author_id) AS unique_authors, min(published_at) AS first_date, max(published_at) AS last_date FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    return similarity.group_details(a.activity(s, d).withColumn("text", F.col("platform")), "platform").drop("keywords")


@register("group_samples", f"SELECT client, seq FROM {COMMENTS} QUALIFY row_number() OVER (PARTITION BY client ORDER BY seq) <= 3")
def _(s, d):
    return similarity.group_samples(a.comments(s, d), "client", "seq").select("client", "seq")


@register("cluster_terms")
def _(s, d):
    return similarity.cluster_terms(similarity.kmeans(a.comments(s, d), 4)).select("cluster", "rank", "term")


@register("thread_depths", f"SELECT post_id || '_c' || idx AS comment_id, CASE WHEN is_reply OR idx % 5 > 1 OR starts_with(text, '@') THEN greatest(2, idx % 5) ELSE 1 END AS depth FROM {THREADS}")
def _(s, d):
    return threads.by_depth(a.threaded(s, d).withColumn("list_depth", F.col("idx") % 5)).select("comment_id", "depth")


@register("thread_distinct_parents", f"""
    WITH k AS (SELECT * FROM {THREADS} QUALIFY row_number() OVER (PARTITION BY post_id, text ORDER BY idx) = 1)
    SELECT post_id || '_c' || idx AS comment_id, CASE WHEN is_reply THEN last_value(CASE WHEN NOT is_reply THEN post_id || '_c' || idx END IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS parent_id FROM k""")
def _(s, d):
    return threads.distinct_then_parents(a.threaded(s, d)).select("comment_id", "parent_id")


MERGED = """(
    WITH op AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0), np AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
    oc AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0 OR l_linenumber % 3 = 0), nc AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 <> 0),
    c AS (SELECT l_orderkey, count(*) AS n FROM (SELECT * FROM oc UNION ALL SELECT * FROM nc n WHERE NOT EXISTS (SELECT 1 FROM oc WHERE oc.l_orderkey = n.l_orderkey AND oc.l_linenumber = n.l_linenumber)) GROUP BY 1),
    p AS (SELECT np.o_orderkey, np.o_orderstatus, CASE WHEN op.o_orderkey IS NULL THEN 'new' ELSE 'updated' END AS change, CASE WHEN op.o_orderkey IS NULL THEN 'second' ELSE 'first' END AS created_at FROM np LEFT JOIN op USING (o_orderkey)
          UNION ALL SELECT o_orderkey, o_orderstatus, 'kept', 'first' FROM op WHERE o_orderkey NOT IN (SELECT o_orderkey FROM np))
    SELECT o_orderkey AS platform_id, o_orderstatus AS platform, change, created_at, coalesce(n, 0) AS n_comments FROM p LEFT JOIN c ON l_orderkey = o_orderkey)"""


def _merged(s, d):
    p = a.posts(s, d).select("platform_id", "platform")
    c = a.post_comments(s, d).select("post_id", F.col("idx").alias("platform_id"))
    old = p.where("platform_id % 3 <> 0").withColumn("created_at", F.lit("first"))
    new = p.where("platform_id % 2 = 0 or platform_id % 3 = 0").withColumn("created_at", F.lit("second"))
    return store.merge_extractions(old, new, c.where("platform_id % 2 = 0 OR platform_id % 3 = 0"), c.where("platform_id % 3 <> 0"))


@register("merge_extractions", f"SELECT platform_id, platform, change, created_at, n_comments FROM {MERGED}")
def _(s, d):
    return _merged(s, d).select("platform_id", "platform", "change", "created_at", "n_comments")


@register("merge_totals", f"SELECT count(*) AS total_posts, sum(n_comments)::BIGINT AS total_comments, list_sort(list(DISTINCT platform)) AS platforms, count(*) FILTER (change = 'new') AS new_posts, count(*) FILTER (change = 'updated') AS updated_posts FROM {MERGED}")
def _(s, d):
    return store.merge_totals(_merged(s, d))


@register("existing_ids_of_posts", f"SELECT DISTINCT platform_id FROM {COMMENTS} WHERE client = 'src1' AND platform = 'en' AND post_id IN (SELECT 'p' || n_nationkey FROM nation)")
def _(s, d):
    posts = a.table(s, d, "nation").select(F.concat(F.lit("p"), "n_nationkey").alias("post_id"))
    return store.existing_ids(a.comments(s, d), "src1", "en", posts)


@register("post_set_issues", """
    SELECT c_custkey AS account_id, count(o_orderkey) AS post_count, CASE WHEN count(o_orderkey) = 0 THEN ['No posts extracted'] ELSE list_filter([CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) > count(*) * 0.5 THEN 'Missing text' END, CASE WHEN count(*) FILTER (o_orderkey % 9 = 0) > 0 THEN 'Missing ids' END], lambda x: x IS NOT NULL) END AS issues
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(s, d):
    p = a.posts(s, d).select("account_id", F.when(F.col("platform_id") % 2 != 0, "t").alias("text"), F.when(F.col("platform_id") % 9 != 0, F.col("platform_id")).alias("platform_id"))
    return validate.post_set_issues(p, a.table(s, d, "customer").select(F.col("c_custkey").alias("account_id")), "account_id")


@register("request_errors", "SELECT c_custkey, list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'platform' END, CASE WHEN c_custkey % 5 = 0 THEN 'identifier' END, CASE WHEN c_custkey % 6 = 0 THEN 'name' END, CASE WHEN c_custkey NOT BETWEEN 1 AND 1000 THEN 'max_posts' END], lambda x: x IS NOT NULL) AS errors FROM customer")
def _(s, d):
    k = F.col("c_custkey")
    r = a.table(s, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, "myspace").otherwise("facebook").alias("platform"), F.when(k % 5 == 0, "@@a b").otherwise("@name.1").alias("identifier"), F.when(k % 6 == 0, "x").otherwise(F.col("c_name")).alias("name"),
        k.alias("max_posts"), F.lit(10).alias("max_comments"), F.lit("2024-01-01").cast("timestamp").alias("since"), F.lit("2024-02-01").cast("timestamp").alias("until"),
    )
    return validate.request_errors(r, ("facebook", "instagram", "twitter", "linkedin", "google")).select("c_custkey", "errors")


@register("validate_comment_authors", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_suppkey % 7 = 0 THEN ['missing author'] ELSE [] END AS errors, CASE WHEN l_suppkey % 7 <> 0 AND l_suppkey % 3 = 0 THEN ['anonymous author'] ELSE [] END AS warnings FROM lineitem")
def _(s, d):
    k, none = F.col("l_suppkey"), F.lit(None).cast("string")
    name = F.when(k % 3 != 0, "n")
    c = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.lit("c").alias("platform_id"), F.lit("p").alias("post_id"), F.lit("t").alias("text"), F.lit(1).alias("likes"), F.when(k % 7 != 0, F.struct(name.alias("username"), none.alias("display_name"))).alias("author"))
    return validate.comments(c).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "errors", "warnings")


@register("posts_filtered", "SELECT o_orderkey AS platform_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01'")
def _(s, d):
    ts = lambda x: F.lit(x).cast("timestamp")
    return query.select_rows(a.posts(s, d), platform="F", since=ts("1995-01-01"), until=ts("1997-01-01")).select("platform_id")


@register("export_post_projection", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS platform FROM orders")
def _(s, d):
    p = a.posts(s, d).withColumnRenamed("platform_id", "id")
    return export.project(p, export.Options(include=("id", "published_at", "platform"), date_style="iso_date", rename={"published_at": "day"}))


@register("hover_counts", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 2 WHEN 0 THEN l_suppkey * 1000 + 500 ELSE l_suppkey + 1 END AS out FROM lineitem")
def _(s, d):
    n = F.col("l_suppkey").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(n, F.lit(".5K"))).otherwise(F.concat(n, F.lit(".5 likes")))
    return a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", counts.hover_count(text).alias("out"))


@register("drop_empty_fields", "SELECT '{\"platform\":\"' || platform || '\"' || CASE WHEN seq % 2 = 0 THEN ',\"client\":\"' || client || '\"' ELSE '' END || '}' AS value FROM " + COMMENTS)
def _(s, d):
    c = a.comments(s, d).select("platform", F.when(F.col("seq") % 2 == 0, F.col("client")).when(F.col("seq") % 3 == 0, "").alias("client"))
    return export.json_lines(c, export.Options(keep_empty=False))
