"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadmill.llm import bpe, cotrain, divergence, fim, kdtree, langid, mixing, perplexity, ppm, records, simhash, substrings, topk

#: The vocabulary that the queries use; operators take any path.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), VOCABULARY)


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(documents(spark, sf_dir))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rules(documents(spark, sf_dir))


def op5_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(documents(spark, sf_dir), VOCABULARY)


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.eight_shards(documents(spark, sf_dir))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(documents(spark, sf_dir))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(documents(spark, sf_dir))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_twentieth(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.tenth_held_out(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_cotrained_quality": op2_cotrained_quality,
    "op3_language_id": op3_language_id,
    "op4_perplexity_rules": op4_perplexity_rules,
    "op5_record_files": op5_record_files,
    "op6_kd_shards": op6_kd_shards,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_mixture": op8_mixture,
    "op9_top_k": op9_top_k,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_ppm_scores": op12_ppm_scores,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Operators that learn models or use XXH64, CRC-32 or a tokenizer file have no SQL; tests hold them against brute force.
SQL: dict[str, str] = {
    "op8_mixture": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens, md5('7|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
        ), s AS (
            SELECT source, sum(tokens)::BIGINT AS tokens, ceil(greatest(sum(tokens), 1) / 262144)::BIGINT AS blocks FROM t GROUP BY 1
        ), p AS (
            SELECT list(ln(tokens / total)) AS l, count(*) AS n, max(tokens) AS top FROM (SELECT *, sum(tokens) OVER () AS total FROM s WHERE tokens > 0)
        ), entropy(i, low, high) AS (
            SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
                SELECT i, low, high, mid, ln(list_sum(z)) - mid * list_sum(list_transform(list_zip(z, l), lambda x: x[1] * x[2])) / list_sum(z) >= 0.95 * ln(n) AS ok FROM (
                    SELECT i, low, high, mid, l, n, list_transform(l, lambda x: exp(mid * x)) AS z FROM (SELECT *, (low + high) / 2 AS mid FROM entropy, p WHERE i < 24)))
        ), first AS (
            SELECT CASE WHEN n <= 1 OR -list_sum(list_transform(l, lambda x: exp(x) * x)) >= 0.95 * ln(n) THEN 1.0 ELSE floor((SELECT low FROM entropy WHERE i = 24) * 1e6) / 1e6 END AS a, list_max(l) - list_min(l) AS gap, top FROM p
        ), repeats(i, low, high) AS (
            SELECT 0, a, 1.0::DOUBLE FROM first
            UNION ALL
            SELECT i + 1, CASE WHEN ok THEN low ELSE mid END, CASE WHEN ok THEN mid ELSE high END FROM (SELECT i, low, high, (low + high) / 2 AS mid, exp((1 - (low + high) / 2) * gap) <= 4 AS ok FROM repeats, first WHERE i < 24)
        ), a AS (
            SELECT CASE WHEN exp((1 - a) * gap) <= 4 THEN a ELSE ceil((SELECT high FROM repeats WHERE i = 24) * 1e6) / 1e6 END AS a, top FROM first
        ), w AS (
            SELECT source, blocks, tokens, budget, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
            FROM (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE greatest(round(tokens * pow(top / tokens, 1 - a))::BIGINT, tokens) END AS budget FROM s, a)
        ), b AS (
            SELECT t.*, blocks, epochs, rest, ('0x' || left(key, 12))::BIGINT % blocks AS block FROM t JOIN w USING (source)
        ), e AS (
            SELECT source, block, size, epochs, rest, unnest(range(0, epochs + 1)) AS epoch FROM (SELECT source, block, epochs, rest, sum(b.tokens)::BIGINT AS size FROM b GROUP BY ALL)
        ), r AS (
            SELECT *, row_number() OVER o AS block_rank, sum(size) OVER o - size AS before FROM e WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('7|' || source || '|' || epoch || '|' || block), block ROWS UNBOUNDED PRECEDING)
        )
        SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, block, block_rank::INTEGER AS block_rank FROM (
            SELECT b.doc_id, b.source, b.tokens, r.epoch, b.block, r.block_rank, r.epoch < r.epochs OR before + size <= r.rest OR (before < r.rest AND before + sum(b.tokens) OVER (PARTITION BY b.source, b.block, r.epoch ORDER BY b.key) <= r.rest) AS ok
            FROM b JOIN r ON b.source = r.source AND b.block = r.block WHERE r.epoch < r.epochs OR before < r.rest)
        WHERE ok""",
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        QUALIFY rank <= 20""",
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), p AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i : i + 19], ' ')))) AS "window" FROM d WHERE len(w) >= 20
        ), g AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY "window" ORDER BY doc_id, i) AS k FROM p
        ), c AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM g WHERE k > 1
        ), x AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d
        ), kept AS (
            SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.at) AS text FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.at = c.at GROUP BY 1
        )
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), k AS (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL
        ), v AS (
            SELECT lang, count(*) AS v FROM k GROUP BY 1
        ), l AS (
            SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY 1, 2
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * v) AS p, 1 + 1000000000::HUGEINT * (l.n + 5) // (l.total + 5 * v) AS q
            FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang JOIN l ON k.lang = l.lang AND k.term = l.term
            LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
            LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) t ON g.lang = t.lang AND g.source = t.source
        ), x AS (
            SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM (SELECT g.lang, g.source, o.source AS item FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source)
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) USING (lang, source, item)
            UNION ALL
            SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x QUALIFY part = 'pair' OR rank <= 50""",
    "op13_fill_in_middle": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), d AS (
            SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
        ), p AS (
            SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p""",
}
