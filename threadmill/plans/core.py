"""Queries over comments, posts and threads, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.operators import query, store, threads, validate
from threadmill.sources import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The adapters of ``threadmill.sources.adapters`` in SQL.
COMMENTS = "(SELECT doc_id AS seq, source AS client, lang AS platform, doc_id::VARCHAR AS platform_id, 'p' || (doc_id % 50) AS post_id, text, n_chars AS likes FROM documents)"
ACTIVITY = "(SELECT event_id AS seq, user_id AS author_id, event_type AS platform, ts AS published_at, value AS likes, props::JSON->>'$.k' AS post_id FROM events)"
THREADS = "(SELECT conv_id AS post_id, turn AS idx, role, text, role <> 'user' AS is_reply FROM conversations)"


#: The adaptive delay of each author after its events in order, step by step.
FOLD = """
    o AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'click' THEN 'error' ELSE 'success' END AS o FROM events),
    f(key, k, d, s, e) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 2000::BIGINT, 0, 0 FROM events
        UNION ALL
        SELECT f.key, o.k, CASE o WHEN 'success' THEN CASE WHEN s + 1 >= 10 AND greatest(floor(d * 0.9::DOUBLE), 500) < d THEN greatest(floor(d * 0.9::DOUBLE), 500) ELSE d END WHEN 'rate_limit' THEN least(floor(d * 1.5::DOUBLE), 30000) ELSE CASE WHEN e >= 1 THEN least(floor(d * 1.2::DOUBLE), 30000) ELSE d END END::BIGINT,
               CASE WHEN o = 'success' AND NOT (s + 1 >= 10 AND greatest(floor(d * 0.9::DOUBLE), 500) < d) THEN s + 1 ELSE 0 END, CASE WHEN o = 'success' THEN 0 ELSE e + 1 END
        FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1),
    last AS (SELECT key, arg_max(d, k) AS d, arg_max(e, k) AS e FROM f GROUP BY 1)"""


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@register("comments_filter_since_until", f"SELECT seq, author_id, platform, published_at, likes FROM {ACTIVITY} WHERE platform = 'view' AND published_at >= TIMESTAMP '{SINCE}' AND published_at <= TIMESTAMP '{UNTIL}'")
def _(s, d):
    return query.select_rows(a.activity(s, d), platform="view", since=F.lit(SINCE).cast("timestamp"), until=F.lit(UNTIL).cast("timestamp")).select("seq", "author_id", "platform", "published_at", "likes")


@register("comments_latest_n", f"SELECT seq, author_id, published_at FROM {ACTIVITY} ORDER BY published_at DESC NULLS LAST, seq LIMIT 25")
def _(s, d):
    return query.select_rows(a.activity(s, d), limit=25).select("seq", "author_id", "published_at")


@register("comments_page", f"SELECT seq, client, platform FROM {COMMENTS} ORDER BY likes DESC, seq LIMIT 50 OFFSET 100")
def _(s, d):
    return query.page(a.comments(s, d), [F.desc("likes"), F.asc("seq")], 3, 50).select("seq", "client", "platform")


@register("comments_page_info", f"SELECT count(*) AS total, count(*) > 150 AS has_more FROM {COMMENTS}")
def _(s, d):
    return a.comments(s, d).agg(F.count("*").alias("total"), (F.count("*") > 150).alias("has_more"))


@register("comments_since_or_undated", f"SELECT seq FROM {ACTIVITY} WHERE published_at IS NULL OR published_at >= TIMESTAMP '{SINCE}'")
def _(s, d):
    return query.since_or_undated(a.activity(s, d), F.lit(SINCE).cast("timestamp")).select("seq")


@register("comment_count_by_platform", f"SELECT client, platform, count(*) AS n FROM {COMMENTS} GROUP BY ALL")
def _(s, d):
    return query.counts(a.comments(s, d), "client", "platform")


@register("post_comment_count", f"SELECT client, post_id, count(*) AS n FROM {COMMENTS} GROUP BY ALL")
def _(s, d):
    return query.counts(a.comments(s, d), "client", "post_id")


@register("posts_with_comments", f"SELECT DISTINCT client, post_id FROM {COMMENTS}")
def _(s, d):
    return a.comments(s, d).select("client", "post_id").distinct()


@register("client_stats", f"SELECT client, count(*) AS total_comments, count(DISTINCT post_id) AS total_posts, list_sort(list(DISTINCT platform)) AS platforms FROM {COMMENTS} GROUP BY 1")
def _(s, d):
    return a.comments(s, d).groupBy("client").agg(F.count("*").alias("total_comments"), F.count_distinct("post_id").alias("total_posts"), F.array_sort(F.collect_set("platform")).alias("platforms"))


@register("client_platform_rollup", f"SELECT client, platform, count(*) AS n, sum(likes)::BIGINT AS likes FROM {COMMENTS} GROUP BY ROLLUP (client, platform)")
def _(s, d):
    return a.comments(s, d).rollup("client", "platform").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))


@register("duplicate_groups", f"SELECT client, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text, count(*) AS n, list_sort(list(platform_id)) AS ids FROM {COMMENTS} c GROUP BY client, c.text HAVING count(*) > 1")
def _(s, d):
    return query.duplicate_groups(a.comments(s, d), "client")


@register("duplicate_count", f"SELECT client, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS duplicates FROM (SELECT client, text, count(*) AS n FROM {COMMENTS} GROUP BY ALL) GROUP BY 1")
def _(s, d):
    return query.duplicate_count(a.comments(s, d), "client")


@register("duplicates_top", f"SELECT n, min(seq) AS first FROM (SELECT text, seq, count(*) OVER (PARTITION BY text) AS n FROM {COMMENTS}) GROUP BY text, n ORDER BY n DESC, first LIMIT 10")
def _(s, d):
    return a.comments(s, d).groupBy("text").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(10).select("n", "first")


@register("dedupe_keep_first", f"SELECT seq, client, platform FROM {COMMENTS} QUALIFY row_number() OVER (PARTITION BY text ORDER BY seq) = 1")
def _(s, d):
    return store.keep_first(a.comments(s, d), ["text"], ["seq"]).select("seq", "client", "platform")


@register("delete_duplicates", f"SELECT seq, client FROM {COMMENTS} QUALIFY client <> 'src0' OR row_number() OVER (PARTITION BY client, text ORDER BY seq) = 1")
def _(s, d):
    return store.delete_duplicates(a.comments(s, d), "src0").select("seq", "client")


def _halves(s, d):
    """Two thirds of all rows as the stored table, and a batch of the others and some of those: every row is in one of them at least."""
    c = a.comments(s, d)
    return c.where("seq % 3 <> 0"), c.where("seq % 2 = 0 OR seq % 3 = 0")


OLD, NEW = f"(SELECT * FROM {COMMENTS} WHERE seq % 3 <> 0)", f"(SELECT * FROM {COMMENTS} WHERE seq % 2 = 0 OR seq % 3 = 0)"


@register("insert_ignore", f"SELECT seq, client, platform, platform_id FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE o.platform = n.platform AND o.platform_id = n.platform_id) QUALIFY row_number() OVER (PARTITION BY platform, platform_id ORDER BY seq) = 1")
def _(s, d):
    return store.insert_ignore(*_halves(s, d), required=("client", "text")).select("seq", "client", "platform", "platform_id")


@register("insert_ignore_counts", f"SELECT count(*) FILTER (NOT found) AS saved, count(*) FILTER (found) AS duplicates FROM (SELECT n.seq, o.platform_id IS NOT NULL AS found FROM {NEW} n LEFT JOIN {OLD} o USING (platform, platform_id))")
def _(s, d):
    old, new = _halves(s, d)
    n = new.join(old.select("platform", "platform_id").distinct().withColumn("found", F.lit(True)), ["platform", "platform_id"], "left")
    return n.agg(F.count_if(F.col("found").isNull()).alias("saved"), F.count_if(F.col("found").isNotNull()).alias("duplicates"))


@register("upsert_latest", f"SELECT platform_id, likes FROM (SELECT platform_id, likes, 0 AS k FROM {OLD} UNION ALL SELECT platform_id, likes + 1, 1 FROM {NEW}) QUALIFY row_number() OVER (PARTITION BY platform_id ORDER BY k DESC) = 1")
def _(s, d):
    old, new = _halves(s, d)
    return store.upsert(old, new.withColumn("likes", F.col("likes") + 1), ["platform_id"], "seq").select("platform_id", "likes")


@register("merge_latest_posts", f"SELECT platform_id, likes FROM {NEW} UNION ALL SELECT platform_id, likes FROM {OLD} WHERE platform_id NOT IN (SELECT platform_id FROM {NEW})")
def _(s, d):
    return store.merge_posts(*_halves(s, d)).select("platform_id", "likes")


@register("merge_union_comments", f"SELECT seq, platform_id FROM {OLD} UNION ALL SELECT seq, platform_id FROM {NEW} WHERE platform_id NOT IN (SELECT platform_id FROM {OLD})")
def _(s, d):
    return store.merge_comments(*_halves(s, d)).select("seq", "platform_id")


@register("incremental_changes", f"SELECT n.platform_id, CASE WHEN o.platform_id IS NULL THEN 'new' ELSE 'updated' END AS change FROM {NEW} n LEFT JOIN {OLD} o USING (platform_id) WHERE o.platform_id IS NULL OR n.seq % 4 = 0")
def _(s, d):
    old, new = _halves(s, d)
    return store.changed_since(old, new.withColumn("likes", F.col("likes") + F.when(F.col("seq") % 4 == 0, 1).otherwise(0))).select("platform_id", "change")


@register("exists_batch", f"SELECT platform_id, platform_id IN (SELECT platform_id FROM {OLD}) AS found FROM {NEW}")
def _(s, d):
    old, new = _halves(s, d)
    return store.exists_batch(old, new)


@register("set_union_ids", f"SELECT platform_id FROM {OLD} UNION SELECT platform_id FROM {NEW}")
def _(s, d):
    old, new = _halves(s, d)
    return old.select("platform_id").union(new.select("platform_id")).distinct()


@register("set_difference", f"SELECT platform_id FROM {NEW} EXCEPT SELECT platform_id FROM {OLD}")
def _(s, d):
    old, new = _halves(s, d)
    return new.select("platform_id").subtract(old.select("platform_id"))


@register("set_intersection_ratio", f"SELECT count(*) FILTER (platform_id IN (SELECT platform_id FROM {OLD})) AS known, round(count(*) FILTER (platform_id IN (SELECT platform_id FROM {OLD})) / count(*), 6) AS ratio FROM (SELECT DISTINCT platform_id FROM {NEW})")
def _(s, d):
    old, new = _halves(s, d)
    return store.exists_batch(old, new).agg(F.count_if("found").alias("known"), F.round(F.count_if("found") / F.count("*"), 6).alias("ratio"))


@register("posts_without_comments", "SELECT o_orderkey AS platform_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    return query.without_comments(a.posts(s, d), a.post_comments(s, d).where("flag = 'R'")).select("platform_id")


@register("orphan_comments", "SELECT l_orderkey AS post_id, l_linenumber AS idx FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    return query.orphans(a.post_comments(s, d), a.posts(s, d).where("platform = 'F'")).select("post_id", "idx")


@register("expected_versus_actual", "SELECT o_orderkey AS post_id, count(l_linenumber) AS actual, (o_custkey % 9)::BIGINT AS expected, count(l_linenumber) < 0.5 * (o_custkey % 9) AND (o_custkey % 9) > 5 AS short FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def _(s, d):
    n = a.post_comments(s, d).groupBy("post_id").agg(F.count("*").alias("actual"))
    p = a.posts(s, d).select(F.col("platform_id").alias("post_id"), (F.col("account_id") % 9).alias("expected")).join(n, "post_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return p.withColumn("short", (F.col("actual") < F.col("expected") * 0.5) & (F.col("expected") > 5))


@register("platform_stats_view", "SELECT c_mktsegment AS platform, count(DISTINCT c_custkey) AS accounts, count(DISTINCT o_orderkey) AS posts, count(l_linenumber) AS comments, round(avg(o_totalprice), 4) AS avg_likes FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    n = a.post_comments(s, d).groupBy("post_id").agg(F.count("*").alias("k"))
    p = a.posts(s, d).join(n, F.col("platform_id") == F.col("post_id"), "left").withColumn("rows", F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)))
    per = p.groupBy("account_id").agg(F.count("*").alias("posts"), F.sum(F.coalesce("k", F.lit(0))).alias("comments"), F.sum(F.col("likes") * F.col("rows")).alias("weighted"), F.sum("rows").alias("rows"))
    c = a.table(s, d, "customer").join(per, F.col("c_custkey") == F.col("account_id"), "left")
    return c.groupBy(F.col("c_mktsegment").alias("platform")).agg(F.count("*").alias("accounts"), F.sum(F.coalesce("posts", F.lit(0))).alias("posts"), F.sum(F.coalesce("comments", F.lit(0))).alias("comments"), F.round(F.sum("weighted") / F.sum("rows"), 4).alias("avg_likes"))


@register("extraction_summary_view", "SELECT n_name AS company, count(DISTINCT c_custkey) AS accounts, count(DISTINCT o_orderkey) AS posts FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    per = a.posts(s, d).groupBy("account_id").agg(F.count("*").alias("posts"))
    c = a.table(s, d, "customer").join(per, F.col("c_custkey") == F.col("account_id"), "left").groupBy("c_nationkey").agg(F.count("*").alias("accounts"), F.sum(F.coalesce("posts", F.lit(0))).alias("posts"))
    return a.table(s, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("company"), F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("posts", F.lit(0)).alias("posts"))


@register("enabled_targets", "SELECT r_name AS company, n_name AS account, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey WHERE lower(r_name) IN ('asia', 'europe')")
def _(s, d):
    r = a.table(s, d, "region").where(F.lower("r_name").isin("asia", "europe"))
    return a.table(s, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("company"), F.col("n_name").alias("account"), "n_nationkey")


@register("high_water_mark", "SELECT o_custkey AS account_id, max(o_orderdate) AS last_post_date FROM orders GROUP BY 1")
def _(s, d):
    return a.posts(s, d).groupBy("account_id").agg(F.max("published_at").alias("last_post_date"))


@register("incremental_rows", f"SELECT e.seq FROM {ACTIVITY} e JOIN (SELECT author_id, max(published_at) AS mark FROM {ACTIVITY} WHERE seq % 2 = 0 GROUP BY 1) m USING (author_id) WHERE e.published_at > m.mark")
def _(s, d):
    e = a.activity(s, d)
    mark = e.where("seq % 2 = 0").groupBy("author_id").agg(F.max("published_at").alias("mark"))
    return e.join(mark, "author_id").where("published_at > mark").select("seq")


@register("stop_after_known", f"SELECT author_id, seq FROM (SELECT author_id, seq, sum((platform = 'error')::INT) OVER (PARTITION BY author_id ORDER BY seq) AS k FROM {ACTIVITY}) WHERE k < 3")
def _(s, d):
    return query.until_known(a.activity(s, d).withColumn("known", F.col("platform") == "error"), "seq", "known", 3, "author_id").select("author_id", "seq")


@register("stop_after_failures", f"""
    WITH e AS (SELECT author_id, seq, platform IN ('view', 'click') AS failed FROM {ACTIVITY}),
    i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY author_id ORDER BY seq) AS island FROM e),
    r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY author_id, island ORDER BY seq) AS run FROM i),
    f AS (SELECT author_id, min(seq) AS stop FROM r WHERE run >= 5 GROUP BY 1)
    SELECT author_id, seq FROM r LEFT JOIN f USING (author_id) WHERE stop IS NULL OR seq <= stop""")
def _(s, d):
    return query.until_failures(a.activity(s, d).withColumn("failed", F.col("platform").isin("view", "click")), "seq", "failed", 5, "author_id").select("author_id", "seq")


@register("fallback_tiers", "SELECT l_orderkey AS post_id, l_linenumber AS idx FROM lineitem QUALIFY l_quantity % 3 = min(l_quantity % 3) OVER (PARTITION BY l_orderkey)")
def _(s, d):
    return query.best_tier(a.post_comments(s, d).withColumn("tier", F.col("likes") % 3), "tier", "post_id").select("post_id", "idx")


PARENTS = f"SELECT *, post_id || '_c' || idx AS comment_id, CASE WHEN is_reply THEN last_value(CASE WHEN NOT is_reply THEN post_id || '_c' || idx END IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS parent_id FROM {THREADS}"


@register("thread_parent", f"SELECT comment_id, parent_id, CASE WHEN is_reply THEN 2 ELSE 1 END AS depth FROM ({PARENTS})")
def _(s, d):
    return threads.by_flag(a.threaded(s, d)).select("comment_id", "parent_id", "depth")


@register("thread_parent_offset", """
    WITH t AS (SELECT l_orderkey AS post_id, l_linenumber AS idx, max(l_quantity) * 2 AS off FROM lineitem GROUP BY ALL),
    r AS (SELECT *, coalesce(off > min(CASE WHEN off > 0 THEN off END) OVER (PARTITION BY post_id) + 30, false) AS is_reply, post_id || '_c' || idx AS comment_id FROM t)
    SELECT comment_id, CASE WHEN is_reply THEN last_value(CASE WHEN NOT is_reply THEN comment_id END IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS parent_id FROM r""")
def _(s, d):
    t = a.post_comments(s, d).groupBy("post_id", "idx").agg((F.max("likes") * 2).alias("offset_left")).withColumn("text", F.lit("x"))
    return threads.by_offset(t).select("comment_id", "parent_id")


@register("thread_flat", f"SELECT post_id || '_r' || idx AS comment_id FROM {THREADS} QUALIFY row_number() OVER (PARTITION BY post_id, text ORDER BY idx) = 1")
def _(s, d):
    return threads.flat(a.threaded(s, d)).select("comment_id")


@register("dedupe_first_50", f"SELECT post_id, idx FROM {THREADS} QUALIFY row_number() OVER (PARTITION BY post_id, concat_ws(':', role, left(text, 50)) ORDER BY idx) = 1")
def _(s, d):
    return threads.first_of(a.threaded(s, d).withColumnRenamed("role", "author"), threads.SAME["facebook"]()).select("post_id", "idx")


@register("reply_counts", f"WITH p AS ({PARENTS}) SELECT p.comment_id, count(c.comment_id) AS replies_count FROM p LEFT JOIN p c ON c.parent_id = p.comment_id GROUP BY 1")
def _(s, d):
    return threads.reply_counts(threads.by_flag(a.threaded(s, d))).select("comment_id", "replies_count")


@register("thread_positions", f"SELECT post_id, idx, row_number() OVER (PARTITION BY post_id ORDER BY idx) AS position, length(lag(text) OVER (PARTITION BY post_id, role ORDER BY idx)) AS previous_length FROM {THREADS}")
def _(s, d):
    return threads.positions(a.threaded(s, d)).select("post_id", "idx", F.col("position").cast("long").alias("position"), F.length("previous").cast("long").alias("previous_length"))


@register("nested_posts", f"SELECT post_id, count(*) AS n, list(idx ORDER BY idx) AS turns FROM {THREADS} GROUP BY 1")
def _(s, d):
    t = a.threaded(s, d).groupBy("post_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("idx")).alias("turns"))
    return t


@register("flattened_posts", f"SELECT post_id, idx FROM {THREADS}")
def _(s, d):
    nested = a.threaded(s, d).groupBy("post_id").agg(F.collect_list(F.struct("idx", "text")).alias("comments"))
    return nested.select("post_id", F.explode("comments").alias("c")).select("post_id", "c.idx")


@register("account_stats", f"SELECT post_id, count(*) FILTER (NOT is_reply) AS top_level, count(*) FILTER (is_reply) AS replies, round(count(*) FILTER (is_reply) / count(*), 4) AS ratio FROM {THREADS} GROUP BY 1")
def _(s, d):
    return a.threaded(s, d).groupBy("post_id").agg(F.count_if(~F.col("is_reply")).alias("top_level"), F.count_if("is_reply").alias("replies"), F.round(F.count_if("is_reply") / F.count("*"), 4).alias("ratio"))


@register("validate_comments", f"SELECT platform_id, list_filter([CASE WHEN text IS NULL OR text = '' THEN 'empty text' END, CASE WHEN length(text) > 10000 THEN 'unusually long text' END], lambda x: x IS NOT NULL) AS warnings, true AS is_valid FROM {COMMENTS}")
def _(s, d):
    return validate.comments(a.comments(s, d)).select("platform_id", "warnings", "is_valid")


@register("validate_posts_strict", "SELECT o_orderkey AS platform_id, list_filter(['missing url', CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'future published_at' END], lambda x: x IS NOT NULL) AS errors, false AS is_valid FROM orders")
def _(s, d):
    p = a.posts(s, d).withColumns({"url": F.lit(None).cast("string"), "text": F.lit("x"), "comments_count": F.lit(0)})
    return validate.posts(p, F.lit("1998-01-01").cast("timestamp"), strict=True).select("platform_id", "errors", "is_valid")


@register("quality_report", f"""
    WITH h AS (SELECT client, left(coalesce(text, ''), 50) AS head, count(*) AS n, count(*) FILTER (length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 5) AS texts FROM {COMMENTS} GROUP BY ALL)
    SELECT client, sum(n)::BIGINT AS comment_count, round(sum(texts) / sum(n), 6) AS text_rate, 1.0::DOUBLE AS author_rate, round(sum(n - 1) / sum(n), 6) AS duplicate_rate,
           (100 - 20 - CASE WHEN sum(n - 1) / sum(n) > 0.1 THEN 25 ELSE 0 END)::INT AS score, CASE WHEN sum(n - 1) / sum(n) > 0.1 THEN 'F' ELSE 'B' END AS grade
    FROM h GROUP BY 1""")
def _(s, d):
    c = a.comments(s, d).withColumns({"author_username": F.col("client"), "published_at": F.lit(None).cast("timestamp")})
    r = validate.comment_rates(c, "client")
    q = validate.quality(r, F.lit(1), F.lit(0))
    return q.select("client", "comment_count", *[F.round(x, 6).alias(x) for x in ("text_rate", "author_rate", "duplicate_rate")], "score", "grade")


@register("uniqueness", f"SELECT count(*) AS total, count(DISTINCT (platform, platform_id)) AS distinct_keys, count(DISTINCT (platform, platform_id)) / count(*) AS uniqueness FROM {COMMENTS}")
def _(s, d):
    return validate.uniqueness(a.comments(s, d), "platform", "platform_id")


@register("latest_per_account", "SELECT o_custkey AS account_id, o_orderkey AS platform_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def _(s, d):
    w = Window.partitionBy("account_id").orderBy(F.desc("published_at"), "platform_id")
    return a.posts(s, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("account_id", "platform_id")
