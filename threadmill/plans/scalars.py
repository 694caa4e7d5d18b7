"""Queries that apply the column functions, to literals where the tables have none, and to texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import counts, dates, safety
from threadmill.functions import text as tx
from threadmill.plans.core import register
from threadmill.sources import adapters as a

NOW = "2024-06-15 12:00:00"


def _cases(s, values: list[str | None]):
    return s.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def _values(cases: list[tuple[str | None, object]], name: str = "out", kind: str = "") -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT i, v, out{kind} AS {name} FROM (VALUES " + ", ".join(f"({i}, {q(v)}, {q(o)})" for i, (v, o) in enumerate(cases)) + ") t(i, v, out)"


#: Inputs and what they must give.
COUNT_BASIC = [("1.2K likes", 1200), ("5M followers", 5000000), ("1,234 comments", 1234), ("1,5K", 15000), ("5 minutes", 5000000), ("none", 0), ("", 0), (None, 0), ("2b", 2000000000), ("1.2.3", 0)]
COUNT_INTL = [("8,5 mil", 8500), ("1,2 millones", 1200000), ("500 mil", 500000), ("1.234", 1), ("1,234", 1234), ("1.2 million", 12000000), ("1.234,56", 1234), ("1,234.56", 1234), ("1.5K", 1500), ("8,5", 8), ("7b09", 7), (None, 0), ("x", 0)]
TOKENS = [("2mo", "2m"), ("5h ago", "5h"), ("3 d", "3d"), ("x", None), (None, None)]
RELATIVE = [("just now", NOW), ("ayer", "2024-06-14 12:00:00"), ("5 minutes", "2024-06-15 11:55:00"), ("2 months", "2024-06-15 10:00:00"), ("29 sem", "2024-06-15 11:31:00"), ("3 semanas", "2024-05-25 12:00:00"), ("2 w", "2024-06-01 12:00:00"), ("1 y", "2023-06-16 12:00:00"), ("soon", None), (None, None)]
REVIEWS = [("a month ago", "2024-05-16 12:00:00"), ("2 weeks ago", "2024-06-01 12:00:00"), ("3 years ago", "2021-06-16 12:00:00"), ("new", NOW), (None, NOW)]
DURATIONS = [("59", "59s"), ("61", "1m 1s"), ("3725", "1h 2m")]
EMAILS = [("username@gmail.com", "use***@gma***.com"), ("ab@x.org", "**@*.org"), ("me", "**"), ("", ""), ("abcd@host", "abc***@hos***")]
URLS = [("http://user:pw@host:80/x", "http://***@host:80/x"), ("user:pw@host", "***@host"), ("http://host", "http://host"), (None, "")]
NAMES = [("good_name-1", None), ("", "empty"), ("a b", "invalid characters"), ("a..b", "dangerous pattern"), ("con.txt", "reserved"), ("x" * 101, "too long")]
FILES = [("a/b:c?.txt", "a_b_c_.txt"), (" .x. ", "x"), ("..", "unnamed"), ("con.log", "_con.log"), ("a..b", "a_b")]
ERRORS = [("Connection timeout", "timeout"), ("HTTP 429", "rate_limit"), ("dns failure", "network"), ("401", "auth"), ("404 page", "not_found"), ("page crashed", "browser"), ("odd", "unknown")]
FACEBOOK = [("https://f/x/posts/123", "123"), ("https://f/?story_fbid=9&id=1", "9"), ("https://f/photos/a.1/456/", "456"), ("https://f/pfbid0" + "a" * 24, "pfbid0" + "a" * 24), ("https://f/watch?v=77", "77"), ("https://f/none", None)]
TWITTER = [("https://t/u/status/42?s=1", "42"), ("https://t/u", None)]
COUNT_TEXT = [("12 likes", "true"), ("a1b2c3d4e5f6g7h8i9j0klmnopqrstuvw", "false"), ("x" * 101, "false")]
ISO = [("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("bad", None), (None, None)]

for _name, _given, _f, _sql in [
    ("parse_count_basic", COUNT_BASIC, counts.parse_count_basic, "::BIGINT"),
    ("parse_count_intl", COUNT_INTL, counts.parse_count_intl, "::BIGINT"),
    ("relative_token", TOKENS, dates.relative_token, ""),
    ("relative_comment_time", RELATIVE, lambda c: dates.relative_comment(c, F.lit(NOW).cast("timestamp")), "::TIMESTAMP"),
    ("relative_review_date", REVIEWS, lambda c: dates.relative_review(c, F.lit(NOW).cast("timestamp")), "::TIMESTAMP"),
    ("format_duration", DURATIONS, lambda c: dates.format_duration(c.cast("double")), ""),
    ("mask_email", EMAILS, safety.mask_email, ""),
    ("mask_url", URLS, safety.mask_url, ""),
    ("name_errors", NAMES, safety.name_error, ""),
    ("sanitised_names", FILES, safety.sanitise_filename, ""),
    ("error_categories", ERRORS, safety.error_category, ""),
    ("post_ids_facebook", FACEBOOK, lambda c: safety.url_post_id(c, "facebook"), ""),
    ("post_ids_twitter", TWITTER, lambda c: safety.url_post_id(c, "twitter"), ""),
    ("valid_count_text", COUNT_TEXT, counts.valid_count_text, "::BOOLEAN"),
    ("parse_flexible", ISO, dates.parse_flexible, "::TIMESTAMP"),
]:
    register(_name, _values(_given, kind=_sql))(lambda s, d, _given=_given, _f=_f: _cases(s, [v for v, _ in _given]).select("i", "v", _f(F.col("v")).alias("out")))


@register("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS digest FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", F.md5(tx.clean_text(F.col("text"))).alias("digest"))


@register("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 97) || '...' ELSE text END AS short, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS preview FROM documents")
def _(s, d):
    c = F.col("text")
    return a.table(s, d, "documents").select("doc_id", tx.truncate(c).alias("short"), tx.preview(c).alias("preview"))


@register("mentions_and_tags", r"SELECT conv_id, turn, regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1) AS tags, regexp_extract_all(text, '@([\p{L}\p{N}_.]+)', 1) AS mentions FROM conversations")
def _(s, d):
    c = F.col("text")
    return a.table(s, d, "conversations").select("conv_id", "turn", tx.hashtags(c).alias("tags"), tx.mentions(c).alias("mentions"))


@register("numbers_in_text", "SELECT doc_id, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x AS BIGINT)) AS numbers FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", counts.extract_numbers(F.col("text")).alias("numbers"))


@register("urls_in_text", r"SELECT doc_id, regexp_extract_all(text, 'https?://[^\x20\x09-\x0D]+') AS urls FROM documents")
def _(s, d):
    return a.table(s, d, "documents").select("doc_id", tx.urls(F.col("text")).alias("urls"))


@register("mask_credential", "SELECT c_custkey, left(c_name, 3) || '***' AS masked FROM customer")
def _(s, d):
    return a.table(s, d, "customer").select("c_custkey", safety.mask_credential(F.col("c_name")).alias("masked"))


@register("date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate)::BIGINT::VARCHAR AS epoch, strftime(o_orderdate, '%Y-%m') AS month, hour(o_orderdate) BETWEEN 2 AND 5 AS quiet FROM orders")
def _(s, d):
    c = F.col("o_orderdate")
    return a.table(s, d, "orders").select("o_orderkey", dates.formatted(c, "iso").alias("iso"), dates.formatted(c, "iso_date").alias("day"), dates.formatted(c, "timestamp").alias("epoch"), dates.month(c).alias("month"), dates.quiet_hours(c).alias("quiet"))


@register("retry_waits", "SELECT c, a, CASE c WHEN 'network' THEN least(60, 5 * 2 ** a) WHEN 'timeout' THEN least(60, 10 * (a + 1)) WHEN 'browser' THEN 5 * (a + 1) WHEN 'rate_limit' THEN least(300, 60 * (a + 1)) END::DOUBLE AS wait FROM (SELECT unnest(['network', 'timeout', 'browser', 'rate_limit', 'auth']) AS c), range(0, 6) t(a)")
def _(s, d):
    r = s.range(0, 6).select(F.col("id").alias("a"), F.explode(F.array(*[F.lit(c) for c in ("network", "timeout", "browser", "rate_limit", "auth")])).alias("c"))
    return r.withColumn("wait", safety.retry_wait(F.col("c"), F.col("a")))


@register("cache_keys", "SELECT c_custkey, md5('q:client=' || c_mktsegment || ':k=' || c_custkey) AS key FROM customer")
def _(s, d):
    return a.table(s, d, "customer").select("c_custkey", safety.cache_key(F.lit("q"), client=F.col("c_mktsegment"), k=F.col("c_custkey")).alias("key"))


@register("unicode_normalised")
def _(s, d):
    return a.table(s, d, "conversations").select("conv_id", "turn", tx.clean_nfkc(F.col("text")).alias("clean"), tx.preprocess_comment(F.col("text")).alias("plain"))


# The column functions over whole tables: inputs are built from columns, and the SQL computes from these columns what must come out.


def _with(s, d, name, key, text, f):
    return a.table(s, d, name).select(*key, f(text).alias("out"))


_LINE = ["l_orderkey", "l_linenumber", "l_suppkey"]


@register("parse_count_rows", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN l_suppkey * 1000 WHEN 1 THEN l_suppkey * 1000000 WHEN 2 THEN l_suppkey ELSE 0 END AS out FROM lineitem")
def _(s, d):
    n, k = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(n, F.lit("K likes"))).when(k == 1, F.concat(n, F.lit(" m followers"))).when(k == 2, F.concat(n, F.lit(" shares"))).otherwise("none")
    return _with(s, d, "lineitem", _LINE, text, counts.parse_count_basic)


@register("parse_count_intl_rows", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN l_suppkey * 1000 WHEN 1 THEN l_suppkey * 1000000 + 500000 WHEN 2 THEN l_suppkey ELSE l_suppkey * 1000 END AS out FROM lineitem")
def _(s, d):
    n, k = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(n, F.lit(" mil"))).when(k == 1, F.concat(n, F.lit(",5 millones"))).when(k == 2, F.concat(n, F.lit(" me gusta"))).otherwise(F.concat(n, F.lit("k")))
    return _with(s, d, "lineitem", _LINE, text, counts.parse_count_intl)


@register("relative_token_rows", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN l_suppkey || 'h' WHEN 1 THEN l_suppkey || 'd' END AS out FROM lineitem")
def _(s, d):
    n, k = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 3
    return _with(s, d, "lineitem", _LINE, F.when(k == 0, F.concat(n, F.lit("h ago"))).when(k == 1, F.concat(F.lit(" "), n, F.lit(" d"))).otherwise("soon"), dates.relative_token)


@register("relative_comment_rows", f"SELECT l_orderkey, l_linenumber, l_suppkey, TIMESTAMP '{NOW}' - CASE l_linenumber % 4 WHEN 0 THEN l_suppkey * 60 WHEN 1 THEN l_suppkey * 3600 WHEN 2 THEN l_suppkey * 604800 ELSE 86400 END * INTERVAL 1 SECOND AS out FROM lineitem")
def _(s, d):
    n, k = F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(n, F.lit(" minutes"))).when(k == 1, F.concat(n, F.lit("h"))).when(k == 2, F.concat(n, F.lit(" semanas"))).otherwise("ayer")
    return _with(s, d, "lineitem", _LINE, text, lambda c: dates.relative_comment(c, F.lit(NOW).cast("timestamp")))


@register("relative_review_rows", f"SELECT l_orderkey, l_linenumber, l_suppkey, TIMESTAMP '{NOW}' - CASE l_linenumber % 3 WHEN 0 THEN l_suppkey * 604800 WHEN 1 THEN 2592000 ELSE 0 END * INTERVAL 1 SECOND AS out FROM lineitem")
def _(s, d):
    k = F.col("l_linenumber") % 3
    text = F.when(k == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit(" weeks ago"))).when(k == 1, "a month ago")
    return _with(s, d, "lineitem", _LINE, text, lambda c: dates.relative_review(c, F.lit(NOW).cast("timestamp")))


@register("duration_rows", "SELECT o_orderkey, CASE WHEN x < 60 THEN x || 's' WHEN x < 3600 THEN x // 60 || 'm ' || x % 60 || 's' ELSE x // 3600 || 'h ' || x % 3600 // 60 || 'm' END AS out FROM (SELECT o_orderkey, o_custkey * 7 AS x FROM orders)")
def _(s, d):
    return _with(s, d, "orders", ["o_orderkey"], F.col("o_custkey") * 7, lambda c: dates.format_duration(c.cast("double")))


@register("mask_email_rows", "SELECT c_custkey, left(c_mktsegment, 3) || '***@mai***.' || CASE WHEN c_custkey % 2 = 0 THEN 'com' ELSE 'org' END AS out FROM customer")
def _(s, d):
    text = F.concat("c_mktsegment", F.lit("."), F.col("c_custkey").cast("string"), F.lit("@mailhost."), F.when(F.col("c_custkey") % 2 == 0, "com").otherwise("org"))
    return _with(s, d, "customer", ["c_custkey"], text, safety.mask_email)


@register("mask_url_rows", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'http://***@host/' || page_id ELSE url END AS out FROM pages WHERE NOT contains(url, '@')")
def _(s, d):
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("http://user:pw@host/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return a.table(s, d, "pages").where(~F.contains("url", F.lit("@"))).select("page_id", safety.mask_url(text).alias("out"))


@register("name_error_rows", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'invalid characters' WHEN 1 THEN 'empty' WHEN 2 THEN 'reserved' WHEN 3 THEN 'dangerous pattern' END AS out FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, F.concat("c_name", F.lit("#"))).when(k == 1, "").when(k == 2, "aux.txt").when(k == 3, F.concat(F.lit("a.."), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return _with(s, d, "customer", ["c_custkey"], text, safety.name_error)


@register("sanitised_name_rows", "SELECT p_partkey, p_partkey || '_' || regexp_replace(p_brand, '[<>:\"/|?*]', '_', 'g') || '_x' AS out FROM part")
def _(s, d):
    return _with(s, d, "part", ["p_partkey"], F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(":"), "p_brand", F.lit("/x.")), safety.sanitise_filename)


@register("sanitised_component_rows", "SELECT p_partkey, p_partkey || '_' || lower(p_brand) AS out FROM part")
def _(s, d):
    return _with(s, d, "part", ["p_partkey"], F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_brand", F.lit("/")), safety.sanitise_component)


@register("path_leaves_rows", "SELECT p_partkey, p_partkey % 4 <> 3 AS out FROM part")
def _(s, d):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("a/../"), "p_brand")).when(k == 1, F.concat(F.lit("/"), "p_brand")).when(k == 2, F.concat(F.lit("~"), "p_brand")).otherwise(F.concat(F.lit("a/..b/"), "p_brand"))
    return _with(s, d, "part", ["p_partkey"], text, safety.path_leaves)


@register("error_contexts", """
    SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'rate_limit' WHEN 'view' THEN 'network' ELSE 'unknown' END AS category, event_type IN ('error', 'click', 'view') AS retryable,
           CASE event_type WHEN 'error' THEN least(60, 10 * (event_id % 4 + 1)) WHEN 'click' THEN least(300, 60 * (event_id % 4 + 1)) WHEN 'view' THEN least(60, 5 * 2 ** (event_id % 4)) END::DOUBLE AS wait, user_id::VARCHAR AS account FROM events""")
def _(s, d):
    t = F.col("event_type")
    message = F.when(t == "error", "Timeout after 30 s").when(t == "click", "HTTP 429").when(t == "view", "DNS failure").otherwise("odd")
    e = a.table(s, d, "events").select("event_id", safety.error_context(message, F.col("event_id") % 4, account=F.col("user_id")).alias("x"))
    return e.select("event_id", "x.category", "x.retryable", "x.wait", F.col("x.context")["account"].alias("account"))


@register("blocked_pages", "SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS out FROM pages")
def _(s, d):
    url = F.when(F.col("page_id") % 3 == 0, "https://x/checkpoint/1").otherwise("https://x/p")
    text = F.when(F.col("page_id") % 5 == 0, "Please try again later").otherwise("hello")
    return a.table(s, d, "pages").select("page_id", safety.blocked(url, text, "linkedin").alias("out"))


@register("post_id_rows", "SELECT o_orderkey, o_orderkey::VARCHAR AS facebook, 'c' || o_orderkey AS instagram, o_orderkey::VARCHAR AS twitter, o_orderkey::VARCHAR AS linkedin, 'g' || o_orderkey AS google FROM orders")
def _(s, d):
    n = F.col("o_orderkey").cast("string")
    urls = {"facebook": F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://f/u/posts/"), n)).otherwise(F.concat(F.lit("https://f/?story_fbid="), n)), "instagram": F.concat(F.lit("https://i/p/c"), n, F.lit("/x")), "twitter": F.concat(F.lit("https://t/u/status/"), n, F.lit("?s=1")), "linkedin": F.concat(F.lit("https://l/urn:li:activity:"), n), "google": F.concat(F.lit("https://g/?q=place_id:g"), n, F.lit("&x"))}
    return a.table(s, d, "orders").select("o_orderkey", *[safety.url_post_id(u, p).alias(p) for p, u in urls.items()])


@register("valid_count_text_rows", "SELECT c_custkey, c_custkey % 60 <= 20 OR c_custkey % 60 < 4 AS out FROM customer WHERE c_custkey % 60 <= 50 UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 60 > 50")
def _(s, d):
    return _with(s, d, "customer", ["c_custkey"], F.repeat(F.lit("a1"), (F.col("c_custkey") % 60).cast("int")), counts.valid_count_text)


@register("parse_flexible_rows", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN date_trunc('day', o_orderdate) WHEN 5 THEN NULL WHEN 0 THEN o_orderdate ELSE date_trunc('second', o_orderdate) END AS out FROM orders")
def _(s, d):
    c, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    at = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(k == 1, F.concat(at, F.lit("Z"))).when(k == 2, F.concat(at, F.lit("+0000"))).when(k == 3, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).when(k == 4, F.date_format(c, "yyyy-MM-dd")).otherwise("someday")
    return _with(s, d, "orders", ["o_orderkey"], text, dates.parse_flexible)
