"""Queries on commenters, metrics, similarity and exports, each with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import commenters, export, ingest, metrics, similarity, store, validate, vectors
from threadmill.plans.core import ACTIVITY, COMMENTS, FOLD, register
from threadmill.sources import adapters as a
from threadmill.sources import files


@register("client_overview", f"""
    WITH g AS (SELECT client, platform, text, count(*) AS n, sum(likes) AS likes FROM {COMMENTS} GROUP BY ALL)
    SELECT client, platform, sum(n)::BIGINT AS comments, count(*) AS distinct_texts, sum(n - 1)::BIGINT AS duplicates, sum(likes)::BIGINT AS likes, round(sum(n - 1) / sum(n), 6) AS duplicate_rate FROM g GROUP BY ALL""")
def _(s, d):
    g = a.comments(s, d).groupBy("client", "platform", "text").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))
    return g.groupBy("client", "platform").agg(F.sum("n").alias("comments"), F.count("*").alias("distinct_texts"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("likes").alias("likes"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("duplicate_rate"))


PROFILE = f"(SELECT author_id, count(*) AS total_comments, avg(likes) AS avg_likes, list_sort(list(DISTINCT platform)) AS platforms, min(published_at) AS first_seen, max(published_at) AS last_seen FROM {ACTIVITY} GROUP BY 1)"


@register("commenter_profile", f"SELECT author_id, total_comments, round(avg_likes, 6) AS avg_likes, platforms, first_seen, last_seen, round(total_comments / greatest((last_seen::DATE - first_seen::DATE) / 30.0, 1.0), 6) AS per_month FROM {PROFILE}")
def _(s, d):
    p = commenters.profiles(a.activity(s, d))
    return p.withColumns({c: F.round(c, 6) for c in ("avg_likes", "per_month")})


SHARE = f"(SELECT author_id, count(*) AS n, count(*) FILTER (platform = 'purchase') / count(*) AS pos, count(*) FILTER (platform = 'error') / count(*) AS neg FROM {ACTIVITY} GROUP BY 1)"
CLASS = f"(SELECT author_id, CASE WHEN n >= 20 AND pos >= 0.7 THEN 'super_fan' WHEN n >= 10 AND pos >= 0.6 THEN 'frequent_positive' WHEN n >= 10 AND neg >= 0.6 THEN 'frequent_negative' WHEN n >= 3 THEN 'occasional' ELSE 'one_time' END AS class FROM {SHARE})"


def _classes(s, d):
    share = lambda p: F.count_if(F.col("platform") == p) / F.count("*")
    g = a.activity(s, d).groupBy("author_id").agg(F.count("*").alias("n"), share("purchase").alias("pos"), share("error").alias("neg"))
    return g.select("author_id", commenters.classify(F.col("n"), F.col("pos"), F.col("neg")).alias("class"))


@register("commenter_class", f"SELECT * FROM {CLASS}")
def _(s, d):
    return _classes(s, d)


@register("commenter_class_shares", f"SELECT class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM {CLASS} GROUP BY 1")
def _(s, d):
    return commenters.class_shares(_classes(s, d), "class")


@register("influence_score", f"SELECT author_id, round(CASE WHEN author_id % 7 = 0 THEN 20 ELSE 0 END + least(avg_likes / 10 * 30, 30) + least(total_comments / 20 * 20, 20) + 7.5 + CASE WHEN date_diff('day', last_seen, TIMESTAMP '2024-02-01') <= 30 THEN 15 WHEN date_diff('day', last_seen, TIMESTAMP '2024-02-01') <= 90 THEN 7.5 ELSE 0 END, 1) AS score FROM {PROFILE}")
def _(s, d):
    p = commenters.profiles(a.activity(s, d))
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.col("last_seen"))
    return p.select("author_id", F.round(commenters.influence(F.col("author_id") % 7 == 0, F.col("avg_likes"), F.col("total_comments"), F.lit(0.5), days, None), 1).alias("score"))


_named = " , ".join(f"count(*) FILTER ({' OR '.join(f'contains(lower(text), $${w}$$)' for w in words)}) AS {i}" for i, words in commenters.ISSUES.items())
_top = "CASE WHEN greatest(coverage, billing, speed, service, app) = 0 THEN NULL " + " ".join(f"WHEN {i} = greatest(coverage, billing, speed, service, app) THEN '{i}'" for i in commenters.ISSUES) + " END"


@register("issue_reporters", f"SELECT *, {_top} AS primary_issue FROM (SELECT client, {_named} FROM {COMMENTS} GROUP BY 1)")
def _(s, d):
    return commenters.issue_counts(a.comments(s, d), "client")


@register("commenter_summary", f"SELECT count(*) AS commenters, round(avg(total_comments), 6) AS mean_comments, (list_sort(list(total_comments)))[count(*) // 2 + 1] AS median_comments, count(*) FILTER (total_comments = 1) AS one_time, round(count(*) FILTER (total_comments > 1) / count(*), 6) AS return_rate FROM {PROFILE}")
def _(s, d):
    r = commenters.summary(commenters.profiles(a.activity(s, d)))
    return r.withColumns({c: F.round(c, 6) for c in ("mean_comments", "return_rate")})


@register("top_contribution", f"SELECT round(sum(total_comments) FILTER (k <= floor(n * 0.1)) / sum(total_comments), 6) AS share FROM (SELECT total_comments, row_number() OVER (ORDER BY total_comments DESC) AS k, count(*) OVER () AS n FROM {PROFILE})")
def _(s, d):
    return commenters.top_share(commenters.profiles(a.activity(s, d))).select(F.round("share", 6).alias("share"))


@register("cross_platform", f"SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN len(platforms) > 1 THEN 'multi' WHEN platforms[1] IN ('view', 'signup') THEN platforms[1] || '_only' END AS bucket FROM {PROFILE}) WHERE bucket IS NOT NULL GROUP BY 1")
def _(s, d):
    return commenters.cross_platform(a.activity(s, d), ("view", "signup"))


@register("platform_consistency", f"SELECT author_id, CASE WHEN count(*) >= 2 THEN var_pop(m) < 0.1 END AS consistent FROM (SELECT author_id, platform, avg(CASE WHEN likes > 50 THEN 1.0 ELSE 0.0 END) AS m FROM {ACTIVITY} GROUP BY ALL) GROUP BY 1")
def _(s, d):
    return commenters.consistency(a.activity(s, d).withColumn("score", F.when(F.col("likes") > 50, 1.0).otherwise(0.0)))


@register("hourly_activity", f"SELECT hour(published_at)::INT AS hour, count(*) AS n FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    return commenters.by_hour(a.activity(s, d))


@register("weekday_activity", f"SELECT dayname(published_at) AS weekday, count(*) AS n FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    return commenters.by_weekday(a.activity(s, d))


@register("activity_heatmap", f"SELECT (dayofweek(published_at) + 1)::INT AS weekday, {', '.join(f'nullif(count(*) FILTER (hour(published_at) = {h}), 0) AS h{h}' for h in range(24))} FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    return commenters.heatmap(a.activity(s, d)).withColumnsRenamed({str(h): f"h{h}" for h in range(24)})


@register("commenter_journey", f"""
    WITH e AS (SELECT author_id, published_at, seq, likes / 100 AS score FROM {ACTIVITY}),
    p AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY published_at, seq) AS k, count(*) OVER (PARTITION BY author_id) AS m FROM e WHERE score > 0),
    t AS (SELECT author_id, max(m) AS m, avg(score) FILTER (k > m // 2) - avg(score) FILTER (k <= m // 2) AS ch FROM p GROUP BY 1)
    SELECT e.author_id, min(published_at) AS first_contact, max(published_at) AS last_contact, count(*)::INT AS n,
           CASE WHEN any_value(m) >= 3 THEN CASE WHEN any_value(ch) > 0.1 THEN 'improving' WHEN any_value(ch) < -0.1 THEN 'declining' ELSE 'stable' END END AS trend
    FROM e LEFT JOIN t ON t.author_id = e.author_id GROUP BY 1""")
def _(s, d):
    return commenters.journey(a.activity(s, d).withColumn("score", F.col("likes") / 100))


@register("sentiment_by_platform", "SELECT lang AS platform, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (toxic = 1) AS negative, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neutral FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    j = a.table(s, d, "documents").select("doc_id", F.col("lang").alias("platform")).join(a.table(s, d, "labels"), "doc_id")
    return j.groupBy("platform").agg(F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("toxic") == 1).alias("negative"), F.count_if((F.col("quality") != 1) & (F.col("toxic") != 1)).alias("neutral"))


@register("word_frequency", r"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def _(s, d):
    w = a.table(s, d, "documents").select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)


@register("exact_dedupe", f"SELECT min(seq) AS seq, count(*) - 1 AS duplicate_count FROM {COMMENTS} GROUP BY lower(trim(text))")
def _(s, d):
    return similarity.exact(a.comments(s, d)).select("seq", "duplicate_count")


WORDS = r"(SELECT min(conv_id * 1000 + turn) AS id, w FROM (SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM conversations) WHERE len(w) > 0 GROUP BY w)"


@register("jaccard_pairs", f"SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS similarity FROM {WORDS} x JOIN {WORDS} y ON x.id < y.id WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.7")
def _(s, d):
    c = a.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return similarity.jaccard_pairs(c, 0.7).withColumn("similarity", F.round("similarity", 6))


@register("jaccard_members", r"SELECT seq, min(seq) OVER (PARTITION BY w) AS set_id FROM (SELECT conv_id * 1000 + turn AS seq, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM conversations) WHERE len(w) > 0")
def _(s, d):
    return similarity.word_set_members(a.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text"))


@register("cosine_pairs", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
    SELECT p.vec_id AS a, v.vec_id AS b, round(list_cosine_similarity(p.e, v.e), 6) AS similarity FROM v p JOIN v ON p.vec_id % 20 = 0 AND p.vec_id <> v.vec_id WHERE list_cosine_similarity(p.e, v.e) >= 0.8""")
def _(s, d):
    e = a.table(s, d, "embeddings")
    return similarity.similar_to(e, e.where("vec_id % 20 = 0"), 0.8)


@register("cluster_centroids", "SELECT label, i::INT AS i, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def _(s, d):
    c = similarity.centroids(a.table(s, d, "embeddings"), "label")
    return c.select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


@register("cluster_representatives", """
    WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
    v AS (SELECT label, list(m ORDER BY i) AS centroid FROM c GROUP BY 1)
    SELECT label, vec_id FROM (SELECT label, vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), centroid) AS s FROM embeddings JOIN v USING (label)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) = 1""")
def _(s, d):
    return similarity.representatives(a.table(s, d, "embeddings"), "label")


def _greedy(threshold, within=False):
    """The sequential rule, one row after the other."""
    return f"""WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings
        ), near AS (
            SELECT p.k, list(q.k ORDER BY q.k) AS before FROM v p JOIN v q ON q.k < p.k {'AND p.label = q.label' if within else ''} AND list_cosine_similarity(p.e, q.e) >= {threshold} GROUP BY 1
        ), g(k, leaders) AS (
            SELECT 0::BIGINT, []::BIGINT[]
            UNION ALL
            SELECT g.k + 1, CASE WHEN list_has_any(coalesce(before, []), leaders) THEN leaders ELSE list_append(leaders, g.k + 1) END FROM g LEFT JOIN near ON near.k = g.k + 1 WHERE g.k < (SELECT count(*) FROM v)
        ), led AS (
            SELECT v.vec_id, v.label, list_min(list_append(list_intersect(coalesce(before, []), leaders), CASE WHEN list_contains(leaders, v.k) THEN v.k END)) AS k FROM v LEFT JOIN near ON near.k = v.k, (SELECT leaders FROM g ORDER BY k DESC LIMIT 1)
        ), condensed AS (
            SELECT led.vec_id, led.label, v.vec_id AS leader FROM led JOIN v USING (k)
        ) """


def _density(eps, least, within=False):
    """Every core floods what it reaches; the smallest flood names the cluster."""
    return f"""WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), near AS (
            SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON {'p.label = q.label AND ' if within else ''}list_cosine_similarity(p.e, q.e) >= 1 - {eps}
        ), core AS (
            SELECT a FROM near GROUP BY 1 HAVING count(*) >= {least}
        ), links AS (
            SELECT a, b FROM near SEMI JOIN core ON near.a = core.a SEMI JOIN core c ON near.b = c.a WHERE near.a <> near.b
        ), reached(id, root) AS (
            SELECT a, a FROM core UNION SELECT b, root FROM reached JOIN links ON a = id WHERE b > root
        ), roots AS (
            SELECT id, min(root) AS root FROM reached GROUP BY 1
        ), edge AS (
            SELECT a, min(root) AS root FROM near JOIN roots ON b = id ANTI JOIN core ON near.a = core.a GROUP BY 1
        ) SELECT vec_id, {'label, ' if within else ''}coalesce(r.root, e.root, -1)::BIGINT AS cluster FROM embeddings LEFT JOIN roots r ON vec_id = r.id LEFT JOIN edge e ON vec_id = e.a"""


@register("condense_all", _greedy(0.35) + "SELECT vec_id, leader FROM condensed")
def _(s, d):
    return similarity.condense(a.table(s, d, "embeddings"), 0.35)


@register("condense_report", _greedy(0.35) + "SELECT leader, count(*) AS count, count(DISTINCT label) AS authors FROM condensed GROUP BY 1")
def _(s, d):
    e = a.table(s, d, "embeddings")
    return vectors.condensed(e, similarity.condense(e, 0.35), "label")


@register("density_all", _density(0.65, 3))
def _(s, d):
    return similarity.dbscan(a.table(s, d, "embeddings"), 0.65, 3)


@register("density_representatives", f"""SELECT cluster, vec_id FROM (
        SELECT cluster, vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), m) AS s FROM ({_density(0.65, 3)}) JOIN embeddings USING (vec_id) JOIN (
            SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM ({_density(0.65, 3)}) JOIN embeddings USING (vec_id)) GROUP BY ALL) GROUP BY 1) USING (cluster) WHERE cluster >= 0)
    QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, vec_id) = 1""")
def _(s, d):
    e = a.table(s, d, "embeddings")
    return similarity.representatives(e.join(similarity.dbscan(e, 0.65, 3).where("cluster >= 0"), "vec_id"), "cluster")


@register("cosine_condense", _greedy(0.8, within=True) + "SELECT vec_id, label, leader FROM condensed")
def _(s, d):
    return similarity.condense(a.table(s, d, "embeddings"), 0.8, "label")


@register("minhash_documents")
def _(s, d):
    return similarity.minhash_pairs(a.table(s, d, "documents").select(F.col("doc_id").alias("seq"), "text"))


@register("minhash_pairs")
def _(s, d):
    return similarity.minhash_pairs(a.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text"))


_close = r"""WITH RECURSIVE t AS (
        SELECT doc_id AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM documents
    ), s AS (
        SELECT min(id) AS id, w, len(w) AS n FROM t WHERE len(w) > 0 GROUP BY w
    ), f AS (
        SELECT word, count(*) AS f FROM (SELECT unnest(w) AS word FROM s) GROUP BY 1
    ), o AS (
        SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY f, word) AS k FROM (SELECT id, n, unnest(w) AS word FROM s) JOIN f USING (word)
    ), p AS (
        SELECT DISTINCT x.id AS a, y.id AS b FROM o x JOIN o y ON x.word = y.word AND x.id < y.id AND x.k <= x.n - ceil(x.n * 0.7) + 1 AND y.k <= y.n - ceil(y.n * 0.7) + 1
    ), links AS (
        SELECT a, b FROM p JOIN s x ON a = x.id JOIN s y ON b = y.id WHERE len(list_intersect(x.w, y.w)) >= 0.7 * len(list_distinct(list_concat(x.w, y.w)))
    ), reached(id, root) AS (
        SELECT id, id FROM s UNION SELECT z.other, root FROM reached JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) z ON z.one = reached.id WHERE z.other > root
    ), roots AS (SELECT id, min(root) AS root FROM reached GROUP BY 1)
    """


@register("minhash_groups", _close + 'SELECT t.id AS seq, root AS "group" FROM t JOIN s USING (w) JOIN roots ON s.id = roots.id')
def _(s, d):
    return similarity.minhash_groups(a.table(s, d, "documents").select(F.col("doc_id").alias("seq"), "text"))


@register("tfidf_clusters")
def _(s, d):
    return similarity.kmeans(a.comments(s, d), 4).select("seq", "cluster")


@register("group_report", f"SELECT client, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2)::DOUBLE AS percentage FROM {COMMENTS} GROUP BY 1")
def _(s, d):
    return similarity.group_report(a.comments(s, d), "client").select("client", "count", "percentage")


def _runs(s, d):
    """Orders as runs: their lines are posts, quantities comments and returns errors."""
    i = a.table(s, d, "lineitem")
    g = i.groupBy("l_orderkey").agg(F.count("*").alias("posts"), F.sum("l_quantity").cast("long").alias("comments"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    return a.table(s, d, "orders").join(g, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderstatus").alias("client"), F.col("o_orderpriority").alias("platform"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderkey") % 600).alias("duration"), "posts", "comments", "errors")


RUNS = "(SELECT o_orderkey, o_orderstatus AS client, o_orderpriority AS platform, o_orderdate AS started_at, o_orderkey % 600 AS duration, posts, comments, errors FROM orders JOIN (SELECT l_orderkey, count(*) AS posts, sum(l_quantity)::BIGINT AS comments, count(*) FILTER (l_returnflag = 'R') AS errors FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@register("run_metrics_summary", f"SELECT client, platform, count(*) AS runs, sum(posts)::BIGINT AS posts, sum(comments)::BIGINT AS comments, round(avg(duration), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, round(sum(errors) / count(*), 6) AS error_rate FROM {RUNS} GROUP BY ALL")
def _(s, d):
    r = metrics.summary(_runs(s, d), "client", "platform")
    return r.withColumns({c: F.round(c, 6) for c in ("avg_duration", "error_rate")})


@register("run_rates", f"SELECT o_orderkey, round(CASE WHEN duration > 0 THEN posts / duration ELSE 0 END, 6) AS posts_per_second, round(CASE WHEN duration > 0 THEN comments / duration ELSE 0 END, 6) AS comments_per_second FROM {RUNS}")
def _(s, d):
    return _runs(s, d).select("o_orderkey", F.round(metrics.rate(F.col("posts"), F.col("duration")), 6).alias("posts_per_second"), F.round(metrics.rate(F.col("comments"), F.col("duration")), 6).alias("comments_per_second"))


@register("recent_runs", f"SELECT o_orderkey, started_at FROM {RUNS} ORDER BY started_at DESC, o_orderkey LIMIT 10")
def _(s, d):
    return _runs(s, d).orderBy(F.desc("started_at"), "o_orderkey").limit(10).select("o_orderkey", "started_at")


@register("anomaly_alerts", f"SELECT o_orderkey, list_filter([CASE WHEN posts > 5 AND CASE WHEN duration > 0 THEN posts / (duration / 60) ELSE 0 END < 0.5 THEN 'slow' END, CASE WHEN posts + errors > 10 AND errors / (posts + errors) > 0.3 THEN 'errors' END, CASE WHEN posts > 5 AND comments / posts < 0.1 THEN 'few comments' END], lambda x: x IS NOT NULL) AS alerts FROM {RUNS}")
def _(s, d):
    return metrics.anomalies(_runs(s, d).withColumn("minutes", F.col("duration") / 60)).select("o_orderkey", "alerts")


@register("sliding_minute_requests", f"SELECT seq, count(*) OVER (PARTITION BY platform ORDER BY epoch(published_at)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_window FROM (SELECT seq, platform, date_trunc('second', published_at) AS published_at FROM {ACTIVITY})")
def _(s, d):
    return metrics.sliding(a.activity(s, d), "platform").select("seq", "in_window")


@register("metric_counters", f"SELECT platform, round(sum(likes), 4) AS total, arg_max(likes, (published_at, seq)) AS last, count(*) AS points FROM {ACTIVITY} GROUP BY 1")
def _(s, d):
    e = a.activity(s, d).select("platform", F.col("likes").alias("value"), F.struct("published_at", "seq").alias("ts"))
    return metrics.counters(e, "platform").withColumn("total", F.round("total", 4))


@register("adaptive_delay", f"WITH RECURSIVE {FOLD} SELECT key AS author_id, d AS delay_ms, e AS consecutive_errors, e < 3 AS may_continue FROM last")
def _(s, d):
    e = a.activity(s, d).withColumn("outcome", F.when(F.col("platform") == "error", "rate_limit").when(F.col("platform") == "click", "error").otherwise("success"))
    return metrics.adaptive_delay(e, "author_id", "seq", "outcome")


@register("incomplete_operations", "SELECT user_id::VARCHAR AS op_id FROM events GROUP BY 1 HAVING arg_max(CASE event_type WHEN 'purchase' THEN 'COMMIT' WHEN 'error' THEN 'ROLLBACK' ELSE 'START' END, event_id) = 'START'")
def _(s, d):
    action = F.when(F.col("event_type") == "purchase", "COMMIT").when(F.col("event_type") == "error", "ROLLBACK").otherwise("START")
    lines = a.table(s, d, "events").select(F.concat_ws("|", action, F.col("user_id").cast("string"), F.lit("x")).alias("value"), F.col("event_id").alias("line_no"))
    return files.incomplete(lines)


@register("export_projection", f"SELECT platform_id AS id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS body, likes FROM {COMMENTS}")
def _(s, d):
    c = a.comments(s, d).withColumnRenamed("platform_id", "id")
    return export.project(c, export.Options(include=("id", "text", "likes"), rename={"text": "body"}, max_text=40))


@register("export_dates", f"SELECT seq, strftime(published_at, '%b %d, %Y %I:%M %p') AS published_at FROM {ACTIVITY}")
def _(s, d):
    return export.project(a.activity(s, d).select("seq", "published_at"), export.Options(date_style="human"))


@register("export_json_lines", f"SELECT '{{\"type\":\"comment\",\"platform\":\"' || platform || '\",\"likes\":' || likes || '}}' AS value FROM {COMMENTS}")
def _(s, d):
    return export.json_lines(a.comments(s, d).select("platform", "likes"), export.PRESETS["streaming"], "comment")


@register("export_statistics", f"SELECT count(*) AS total, list_sort(list(DISTINCT platform)) AS platforms, round(avg(likes), 6) AS avg_likes FROM {COMMENTS}")
def _(s, d):
    return export.statistics(a.comments(s, d)).withColumn("avg_likes", F.round("avg_likes", 6))


@register("export_paths", "SELECT o_orderkey, concat_ws('/', lower(o_orderstatus), lower(o_orderpriority), strftime(o_orderdate, '%Y-%m')) AS path FROM orders")
def _(s, d):
    return a.table(s, d, "orders").select("o_orderkey", export.path_parts(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")).alias("path"))


@register("export_batches", f"SELECT seq, ceil(row_number() OVER (ORDER BY seq) / 64)::BIGINT AS batch FROM {COMMENTS}")
def _(s, d):
    return export.batches(a.comments(s, d).select("seq"), ["seq"], 64)


@register("column_widths", "SELECT least(50, greatest(10, greatest(6, max(length(c_name))) + 2))::INT AS c_name, least(50, greatest(10, greatest(12, max(length(c_mktsegment))) + 2))::INT AS c_mktsegment FROM customer")
def _(s, d):
    return export.column_widths(a.table(s, d, "customer").select("c_name", "c_mktsegment"))


@register("retention_keep_n", "SELECT path FROM (SELECT 'a/' || o_orderstatus || '_x_' || o_orderpriority[1:1] || '_' || o_orderkey || '.json' AS path, o_orderpriority[1:1] AS type, o_orderdate AS t FROM orders) QUALIFY row_number() OVER (PARTITION BY type ORDER BY t DESC, path) > 5")
def _(s, d):
    o = a.table(s, d, "orders").select(F.concat(F.lit("a/"), "o_orderstatus", F.lit("_x_"), F.left("o_orderpriority", F.lit(1)), F.lit("_"), "o_orderkey", F.lit(".json")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return export.beyond_newest(o, 5).select("path")


@register("page_titles", r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def _(s, d):
    return a.table(s, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


@register("page_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<link[^>]*>', '', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS digest FROM pages")
def _(s, d):
    return a.table(s, d, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("digest"))


@register("quality_gate", f"SELECT client, CASE WHEN round(sum(n - 1) / sum(n), 6) > 0.01 THEN ['duplicate_rate'] ELSE [] END AS failures FROM (SELECT client, platform_id, text, count(*) OVER () AS z, 1 AS n FROM {COMMENTS}) GROUP BY 1")
def _(s, d):
    g = a.comments(s, d).groupBy("client").agg(F.lit(0.0).alias("duplicate_rate"))
    return validate.gate(g.withColumns({"valid_rate": F.lit(1.0), "author_rate": F.lit(1.0), "score": F.lit(100)})).select("client", "failures")


@register("quality_gate_measured", f"""
    WITH h AS (SELECT client, left(coalesce(text, ''), 50) AS head, count(*) AS n, count(*) FILTER (client NOT IN ('', 'unknown')) AS authors,
                      count(*) FILTER (platform_id IS NOT NULL AND post_id IS NOT NULL AND coalesce(likes, 0) >= 0) AS valid FROM {COMMENTS} GROUP BY ALL),
    p AS (SELECT client, count(*) AS posts, (count(*) FILTER (coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '') = '') > count(*) * 0.5)::INT + (count(*) FILTER (post_id IS NULL) > 0)::INT AS issues
          FROM (SELECT client, post_id, max(text) AS text FROM {COMMENTS} GROUP BY ALL) GROUP BY 1),
    r AS (SELECT client, sum(n) AS comments, sum(valid) / sum(n) AS v, sum(n - 1) / sum(n) AS d, sum(authors) / sum(n) AS a FROM h GROUP BY 1),
    q AS (SELECT r.*, greatest(0, 80 - 5 * issues - CASE WHEN a < 0.7 THEN 15 ELSE 0 END - CASE WHEN d > 0.1 THEN 25 ELSE 0 END - CASE WHEN comments / posts < 0.5 THEN 10 ELSE 0 END)::INT AS score FROM r JOIN p ON r.client IS NOT DISTINCT FROM p.client)
    SELECT client, round(v, 6) AS valid_rate, round(d, 6) AS duplicate_rate, round(a, 6) AS author_rate, score,
           list_filter([CASE WHEN v < 0.95 THEN 'valid_rate' END, CASE WHEN d > 0.01 THEN 'duplicate_rate' END, CASE WHEN a < 0.8 THEN 'author_rate' END, CASE WHEN score < 70 THEN 'score' END], lambda x: x IS NOT NULL) AS failures FROM q""")
def _(s, d):
    c = a.comments(s, d).withColumns({"author_username": F.col("client"), "published_at": F.lit(None).cast("timestamp")})
    g = validate.measured_gate(c, "client")
    return g.select("client", *[F.round(x, 6).alias(x) for x in ("valid_rate", "duplicate_rate", "author_rate")], "score", "failures")


@register("registry_last_wins", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1")
def _(s, d):
    return store.keep_last(a.table(s, d, "customer"), ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey")


@register("density_clusters", _density(0.5, 3, within=True))
def _(s, d):
    return similarity.dbscan(a.table(s, d, "embeddings"), 0.5, 3, "label")


@register("ingest_normalised", "SELECT conv_id AS post_id, CASE WHEN turn % 2 = 0 THEN turn::VARCHAR ELSE conv_id || '_unknown' END AS platform_id, role AS username, 0::BIGINT AS likes FROM conversations")
def _(s, d):
    raw = a.table(s, d, "conversations").select(F.col("conv_id").alias("post_id"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("id"), F.col("role").alias("author"), "text")
    return ingest.comments(raw).select("post_id", "platform_id", F.col("author.username").alias("username"), "likes")


@register("ingest_selected", "SELECT o_orderkey AS platform_id FROM orders JOIN (SELECT o_custkey, max(o_orderdate) AS mark FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) USING (o_custkey) WHERE o_orderdate >= mark AND o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def _(s, d):
    p = a.posts(s, d)
    old = p.where("platform_id % 2 = 0")
    marks = old.groupBy("account_id").agg(F.max("published_at").alias("last_post_date"))
    return ingest.selected(p, marks, old).select("platform_id")


@register("ingest_totals", f"""
    WITH o AS (SELECT * FROM {COMMENTS} WHERE seq % 3 = 0 AND seq % 50 < 25), n AS (SELECT * FROM {COMMENTS} WHERE post_id NOT IN (SELECT post_id FROM o))
    SELECT (SELECT count(DISTINCT post_id) FROM {COMMENTS}) AS posts_scraped, count(*) AS comments_found, count(*) AS new_saved, 0::BIGINT AS duplicates_skipped FROM n""")
def _(s, d):
    c = a.comments(s, d)
    p = c.select(F.col("post_id").alias("platform_id")).distinct()
    return ingest.totals(p, c, c.where("seq % 3 = 0 AND seq % 50 < 25"))
