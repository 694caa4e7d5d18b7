import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import export, results, runs, validate


def test_batches_hold_without_exchange_reuse(spark):
    """Ranges are fixed by value, so that counts and rows agree however often the plan reads its input."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(0, 50_000, 1, 7).select((F.col("id") * 7919 % 50_021).alias("k"), F.when(F.col("id") % 1000 != 0, F.concat(F.lit("n"), F.col("id").cast("string"))).alias("name")).repartition(23)
        for order in (["k"], ["name", "k"]):
            got = export.batches(df, order, 64, rows_each=1000).orderBy(*order).collect()
            assert [r.batch for r in got] == [i // 64 + 1 for i in range(50_000)]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert export.batches(df.limit(0), ["k"], 64).count() == 0


def test_only_parts_with_rows_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    saved = results.save(str(tmp_path), "acc", "facebook", posts=df, comments=df.limit(0), profile=None)
    assert saved == {"posts": f"{tmp_path}/facebook/acc/posts"} and spark.read.parquet(saved["posts"]).count() == 1


def test_verified_write_replaces_and_holds(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        results.save_verified(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    a, b = spark.range(10).repartition(3), spark.range(10).repartition(5)
    assert results.content_digest(a).first() == results.content_digest(b).first() != results.content_digest(spark.range(1, 11)).first()
    assert results.content_digest(a.limit(0)).first().digest == 0


def test_journal_appends(spark, tmp_path):
    for action in ("START", "COMMIT"):
        line = spark.range(1).select(results.journal_line(F.lit(action), F.lit("op1"), F.lit(None).cast("string")).alias("value"))
        results.append_journal(line, f"{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ["COMMIT|op1|", "START|op1|"]


def test_documents_of_an_export(spark):
    df = spark.createDataFrame([("a", "x", 'say "é"', 2, 1), ("b", "y", None, 4, 0)], "id string, platform string, text string, likes int, replies_count int").coalesce(1)
    value = json.loads(export.json_document(df, export.Options(stats=True, sort_keys=True, ensure_ascii=True, indent=None), "c", F.lit("t")).first().value)
    assert value["metadata"] == {"client": "c", "exported_at": "t", "format": "json", "version": "1.0", "total_comments": 2, "platforms": ["x", "y"], "stats": {"avg_likes": 3.0, "total_replies": 1}}
    assert [x["text"] for x in value["comments"]] == ['say "é"', None]
    posts = df.withColumns({"comments_count": F.lit(3), "shares": F.lit(1)}).drop("replies_count")
    s = export.statistics(posts).first()
    assert (s.total_comments, s.total_shares) == (6, 2) and export.statistics(posts.limit(0)).first().total_shares == 0
    text = export.json_document(df, export.Options(metadata=False, ensure_ascii=True), "c", F.lit("t")).first().value
    assert text.startswith("[") and "\\u00e9" in text and "é" not in text


def test_csv_quoting(spark):
    df = spark.createDataFrame([(1, 'a,"b"', None)], "n int, t string, u string")
    lines = lambda q, **o: export.csv_lines(df, export.Options(quoting=q, **o)).first().value
    assert lines(0) == '1,"a,""b""",' and lines(1) == '"1","a,""b""",""' and lines(2) == '1,"a,""b""",""'
    assert lines(0, delimiter=";") == '1;"a,""b""";'
    with pytest.raises(Exception, match="needs quoting"):
        lines(3)


def test_results_are_refused_when_none_is_valid(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    kind = "result_id int, platform_id string, platform string, account_id string, likes int, comments_count int, url string, text string, published_at timestamp"
    bad = spark.createDataFrame([(i, None, "x", "a", 0, 0, "u", "t", None) for i in range(7)], kind)
    none = spark.createDataFrame([], "result_id int, seq int, platform_id string, post_id string, text string, likes int")
    with pytest.raises(ValueError, match="all results are invalid"):
        validate.valid_results(validate.results(bad, none, now))
    assert validate.valid_results(validate.results(bad.limit(0), none, now)).count() == 0
    future = spark.createDataFrame([(1, "p", "x", "a", 0, 0, "u", "t", None)], kind).withColumn("published_at", F.lit("2025-01-01").cast("timestamp"))
    assert validate.results(future, none, now).first().is_valid and not validate.results(future, none, now, strict=True).first().is_valid


def test_runs_without_rows(spark):
    none = spark.createDataFrame([], "posts int, comments int, errors int, rate_limits int, duration int, client string")
    assert runs.recorded(none).first().total_posts == 0
    assert runs.eta(none, 5).first().eta == "calculating..."
    assert runs.histograms(none, {"extraction_duration": [1], "posts_per_extraction": [1], "comments_per_extraction": [1]}).count() == 0


@pytest.mark.parametrize("quoting", [0, 1, 2, 3])
def test_csv_files(spark, tmp_path, quoting):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "n int, t string").coalesce(1)
    path = export.write(df, "csv", str(tmp_path), f"q{quoting}", options=export.Options(quoting=quoting, line_end="\r\n"))
    got = spark.read.csv(path, header=quoting < 2, lineSep="\r\n")
    assert sorted(tuple(r) for r in got.collect() if r[0] != "n") == [("1", "a b"), ("2", "c")]


def test_minhash_finds_what_exact_jaccard_finds(spark):
    from threadmill.operators import similarity

    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("seq"), "text")
    exact = {(r.a, r.b) for r in similarity.jaccard_pairs(df, 0.7).collect()}
    got = {(r.a, r.b): r.similarity for r in similarity.minhash_pairs(df, 0.7).collect()}
    assert len(exact) > 0 and len(exact & got.keys()) >= 0.9 * len(exact)
    member = {r.seq: r.set_id for r in similarity.word_set_members(df).collect()}
    assert all((k in exact) or member[k[0]] == member[k[1]] for k in got)
    assert sum(v == 1.0 for v in got.values()) >= sum(k != v for k, v in member.items())


def test_scores_are_rounded_once(spark, tmp_path):
    """69.0476 is 69.0, which 69.05 on the way would have made 69.1; the score of influence has the same step."""
    import duckdb

    from threadmill.plans import catalogue

    made = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(1) for t in ("orders", "lineitem", "events")}
    lines = spark.createDataFrame([(k % 16 + 1,) for k in range(21)], "line int")
    made["orders"] = made["orders"].withColumns({"o_orderkey": F.lit(1).cast("long"), "o_custkey": F.lit(0).cast("long"), "o_orderstatus": F.lit("O")})
    made["lineitem"] = made["lineitem"].crossJoin(lines).withColumns({"l_orderkey": F.lit(1).cast("long"), "l_suppkey": F.lit(1).cast("long"), "l_linenumber": F.col("line")}).drop("line")
    values = spark.createDataFrame([(2.0,)] * 10 + [(2.167,)], "x double")
    made["events"] = made["events"].crossJoin(values).withColumns({"user_id": F.lit(1).cast("long"), "value": F.col("x").cast(made["events"].schema["value"].dataType)}).drop("x")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t, df in made.items():
        at = f"{tmp_path}/{t}.parquet"
        df.coalesce(1).write.parquet(at)
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/*.parquet'")
    for name in ("quality_score", "influence_score"):
        got = [r.score for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
        column = [x[0] for x in c.execute(catalogue.SQL[name]).description].index("score")
        assert got == [r[column] for r in c.execute(catalogue.SQL[name]).fetchall()], name
    assert catalogue.QUERIES["quality_score"](spark, str(tmp_path)).first().score == 69.0


def test_masking_names_no_type_twice(spark):
    """A value's type is asked for once a level, under keys that name a secret alone; odd values stay as they are."""
    from threadmill.functions import safety

    rows = ['{"token":null,"a":[],"b":{},"c":[{}],"d":[null,1,"x",true,[{"token":"abcdef"}]]}', '{"token":["abcdef",{"token":"abcdef"}],"secret":5,"api_key":"ab","y":"{\\"token\\":1}"}', "[1]", "null", "bad", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", safety.mask_json(F.col("x")).alias("m"))
    assert [r.m for r in df.orderBy("i").collect()] == ['{"a":[],"b":{},"c":[{}],"d":[null,1,"x",true,[{"token":"abcdef"}]],"token":null}', '{"api_key":"**","secret":5,"token":["abcdef",{"token":"abc***"}],"y":"{\\"token\\":1}"}', None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("schema_of_variant") <= 31
