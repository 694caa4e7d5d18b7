"""Queries on stems, searches, dates and markup of texts, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmill.functions import dates, stems
from threadmill.operators import markup, search
from threadmill.plans.core import register
from threadmill.session import shared_path
from threadmill.sources import adapters as a


def _sql_stems(words: str) -> str:
    """The stemmer's rules step by step: ``word`` and ``stem`` of every row of ``words``, from the same tables of suffixes."""
    def end(x: str, suffixes: list[str]) -> str:
        return f"regexp_extract({x}, '{stems.either(suffixes)}', 0)"

    def one_of(x: str, suffixes: list[str]) -> str:
        return f"{x} IN ({', '.join(repr(s) for s in suffixes)})"

    def without(x: str, suffixes: list[str]) -> str:
        return f"CASE WHEN length({x}) - length({end(x, suffixes)}) >= r2 THEN left({x}, length({x}) - length({end(x, suffixes)})) ELSE {x} END"

    plain = lambda x: f"translate({x}, 'áéíóú', 'aeiou')"
    region = lambda p: f"CASE WHEN regexp_matches(w, '{p}') THEN length(regexp_extract(w, '{p}', 0)) ELSE length(w) END"
    return f"""
        s0 AS (SELECT word, w, {region(stems.RV)} AS rv, {region(stems.R1)} AS r1, {region(stems.R2)} AS r2 FROM (SELECT word, lower(word) AS w FROM {words})),
        s1 AS (SELECT *, {end('w', stems.PRONOUNS)} AS p, left(w, length(w) - length({end('w', stems.PRONOUNS)})) AS s FROM s0),
        s2 AS (SELECT *, CASE WHEN p <> '' THEN {end('s', [*stems.ACCENTED, *stems.PLAIN, 'yendo'])} ELSE '' END AS g FROM s1),
        s3 AS (SELECT word, rv, r1, r2, CASE WHEN g = '' OR length(s) - length(g) < rv THEN w WHEN {one_of('g', stems.ACCENTED)} THEN left(s, length(s) - length(g)) || {plain('g')} WHEN g <> 'yendo' OR suffix(s, 'uyendo') THEN s ELSE w END AS a FROM s2),
        s4 AS (SELECT *, {end('a', stems.STANDARD)} AS e, left(a, length(a) - length({end('a', stems.STANDARD)})) AS s FROM s3),
        s5 AS (SELECT word, rv, a, CASE WHEN e = '' THEN a
            WHEN e = 'amente' THEN CASE WHEN length(s) < r1 THEN a WHEN {without('s', ['iv'])} <> s THEN {without('left(s, length(s) - 2)', ['at'])} ELSE {without('s', ['os', 'ic', 'ad'])} END
            WHEN length(s) < r2 THEN a WHEN {one_of('e', stems.DELETED)} THEN s WHEN {one_of('e', stems.AFTER_IC)} THEN {without('s', ['ic'])} WHEN {one_of('e', stems.TO_LOG)} THEN s || 'log' WHEN {one_of('e', stems.TO_U)} THEN s || 'u' WHEN {one_of('e', stems.TO_ENTE)} THEN s || 'ente'
            WHEN e = 'mente' THEN {without('s', ['ante', 'able', 'ible'])} WHEN {one_of('e', stems.QUALITY)} THEN {without('s', ['abil', 'ic', 'iv'])} ELSE {without('s', ['at'])} END AS b FROM s4),
        s6 AS (SELECT *, {end('substring(a, rv::INTEGER + 1)', stems.Y_VERBS)} AS y, {end('substring(a, rv::INTEGER + 1)', [*stems.SOFT_VERBS, *stems.VERBS])} AS e FROM s5),
        s7 AS (SELECT word, rv, CASE WHEN b <> a THEN b WHEN y <> '' AND suffix(left(a, length(a) - length(y)), 'u') THEN left(a, length(a) - length(y)) WHEN {one_of('e', stems.SOFT_VERBS)} AND suffix(left(a, length(a) - length(e)), 'gu') THEN left(a, length(a) - length(e) - 1) ELSE left(a, length(a) - length(e)) END AS c FROM s6),
        s8 AS (SELECT *, {end('c', [*stems.RESIDUAL, *stems.RESIDUAL_E])} AS e, left(c, length(c) - length({end('c', [*stems.RESIDUAL, *stems.RESIDUAL_E])})) AS s FROM s7),
        stemmed AS (SELECT word, {plain(f"CASE WHEN e = '' OR length(s) < rv THEN c WHEN {one_of('e', stems.RESIDUAL_E)} AND suffix(s, 'gu') AND length(s) - 1 >= rv THEN left(s, length(s) - 1) ELSE s END")} AS stem FROM s8)"""


_WORDS = r"w AS (SELECT doc_id AS seq, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents), v AS (SELECT DISTINCT word FROM w),"


def _comments(s, d):
    return a.comments(s, d).select("seq", "text")


@register("word_stems", f"WITH {_WORDS} {_sql_stems('v')} SELECT word, stem FROM stemmed")
def _(s, d):
    return search.vocabulary(search.words(_comments(s, d)))


def _found(s, d, query, every):
    at = shared_path(s, f"index-{uuid.uuid4().hex}")
    search.build(_comments(s, d), at)
    return search.search(s, at, query, every)


_QUERY = ["osada", "ciónes", "las"]


@register("stemmed_search", f"WITH {_WORDS} q AS (SELECT unnest({_QUERY}) AS word), x AS (SELECT word FROM v UNION SELECT word FROM q), {_sql_stems('x')} SELECT seq, count(*) AS score FROM w JOIN stemmed USING (word) WHERE stem IN (SELECT stem FROM stemmed SEMI JOIN q USING (word)) GROUP BY 1 HAVING count(DISTINCT stem) = 3")
def _(s, d):
    return _found(s, d, _QUERY, True)


@register("stemmed_search_any", f"WITH {_WORDS} q AS (SELECT unnest({_QUERY}) AS word), x AS (SELECT word FROM v UNION SELECT word FROM q), {_sql_stems('x')} SELECT seq, count(*) AS score FROM w JOIN stemmed USING (word) WHERE stem IN (SELECT stem FROM stemmed SEMI JOIN q USING (word)) GROUP BY 1")
def _(s, d):
    return _found(s, d, _QUERY, False)


_ES = dates.MONTHS["es"]
#: Twelve ways to write a date, in Spark's and DuckDB's patterns, and whether the year and the time are lost.
_SHAPES = [
    ("MMMM d, yyyy", "%B %-d, %Y", False), ("d MMM yyyy", "%-d %b %Y", False), ("EEEE, MMMM d, yyyy 'at' h:mm a", "%A, %B %-d, %Y at %-I:%M %p", False), ("dd/MM/yyyy", "%d/%m/%Y", False), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", False), ("d.M.yy", "%-d.%-m.%y", False),
    ("MMM d", "%b %-d", True), ("d MMMM", "%-d %B", True), ("MMMM d 'at' HH:mm", "%B %-d at %H:%M", True), ("'posted on' MMM d 'by someone'", "posted on %b %-d by someone", True), ("d 'de' ", "%-d de ", True), ("d 'de' ", "%-d de ", False),
]


@register("post_dates", """
    WITH o AS (SELECT o_orderkey, o_orderkey % 12 AS shape, o_orderdate::TIMESTAMP + INTERVAL (o_custkey % 1440) MINUTE AS t FROM orders),
    p AS (SELECT *, CASE WHEN shape IN (2, 4, 8) THEN t ELSE t::DATE::TIMESTAMP END AS seen, make_timestamp(2000, month(t), CASE WHEN month(t) = 2 AND day(t) = 29 THEN 28 ELSE day(t) END, 0, 0, 0.0) AS d FROM o)
    SELECT o_orderkey, CASE WHEN shape NOT IN (6, 7, 8, 9, 10) THEN seen WHEN month(t) = 2 AND day(t) = 29 THEN NULL
        ELSE make_timestamp(CASE WHEN make_timestamp(2023, month(t), day(t), CASE WHEN shape = 8 THEN hour(t) ELSE 0 END, CASE WHEN shape = 8 THEN minute(t) ELSE 0 END, 0.0) > TIMESTAMP '2023-06-15 12:00:00' THEN 2022 ELSE 2023 END, month(t), day(t), CASE WHEN shape = 8 THEN hour(t) ELSE 0 END, CASE WHEN shape = 8 THEN minute(t) ELSE 0 END, 0.0) END AS at
    FROM p WHERE NOT (month(t) = 2 AND day(t) = 29)""")
def _(s, d):
    """Dates of orders written in twelve shapes and read back; 29 February aside, which most years lack."""
    o = a.table(s, d, "orders").withColumn("t", F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 1440 * 60))
    written = F
    for k, (pattern, _, _) in enumerate(_SHAPES):
        text = F.date_format("t", pattern)
        if k >= 10:
            text = F.concat(text, F.element_at(F.array(*[F.lit(x) for x in _ES]), F.month("t")), F.date_format("t", " 'de' yyyy") if k == 11 else F.lit(""))
        written = written.when(F.col("o_orderkey") % 12 == k, text)
    o = o.where(~((F.month("t") == 2) & (F.dayofmonth("t") == 29)))
    return o.select("o_orderkey", dates.relative_post(written, F.lit("2023-06-15 12:00:00").cast("timestamp")).alias("at"))


@register("page_elements", r"""
    WITH p AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '(?s)<(a href="[^"]*"|div class="ad")>([^<]*)</(a|div)>', 1), regexp_extract_all(html, '(?s)<(a href="[^"]*"|div class="ad")>([^<]*)</(a|div)>', 2))) AS x FROM pages)
    SELECT page_id, CASE WHEN starts_with(x[1], 'a') THEN 'link' ELSE 'ad' END AS kind, count(*) AS n, md5(string_agg(trim(regexp_replace(x[2], '[\x20\x09-\x0D]+', ' ', 'g')), '|' ORDER BY trim(regexp_replace(x[2], '[\x20\x09-\x0D]+', ' ', 'g')))) AS texts FROM p GROUP BY ALL""")
def _(s, d):
    found = markup.elements(a.table(s, d, "pages"), [("ad", lambda tag: markup.has_class(tag, "ad")), ("link", lambda tag: markup.attribute(tag, "href").isNotNull())])
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("texts"))


@register("page_signs", r"""
    WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<div class="ad">([^<]*)</div>', 1), '[\x20\x09-\x0D]+', ' ', 'g')) AS ad FROM pages WHERE html LIKE '%<div class="ad">%')
    SELECT page_id, kind, role, classes, CASE kind WHEN 'dialog' THEN trim('Sorry ' || CASE WHEN page_id % 3 = 0 THEN ad || ' ' ELSE '' END || 'Close') ELSE ad END AS text
    FROM p, (VALUES ('dialog', 'alertdialog', ''), ('error', 'unknown', 'note form-error')) k(kind, role, classes) WHERE kind = 'dialog' OR (page_id % 3 = 0 AND length(ad) BETWEEN 1 AND 499)""")
def _(s, d):
    """The advertisement of each page of three as an error within a dialog, of the others as one without it."""
    p = a.table(s, d, "pages").where(F.contains("html", F.lit('<div class="ad">')))
    inner = F.regexp_extract("html", '(?s)<div class="ad">([^<]*)</div>', 1)
    error = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div class="note form-error"><i>'), inner, F.lit("</i></div>"))).otherwise("")
    dialog = F.concat(F.lit('<div role="alertdialog"><div><p>Sorry<br></div>'), error, F.lit("<script>var x = '</div>';</script><div>Close</div></div>"))
    return markup.signs(p.withColumn("html", F.concat(dialog, F.regexp_replace("html", '(?s)<div class="ad">[^<]*</div>', "")))).drop("at")
