import datetime
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.functions import counts, dates, safety
from threadmill.functions import text as tx
from threadmill.operators import commenters, export, metrics, query, similarity, store, threads, validate
from threadmill.sources import files
from threadmill.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_text(spark):
    v = F.col("v")
    for f, given_, want in [
        (tx.clean_text, " a \n b  ", "a b"), (tx.clean_text, None, ""), (tx.clean_comment, "\x00 a ", "a"), (tx.extract_username, "@a.b", "a.b"), (tx.extract_username, "a b", None),
        (tx.hashtags, "#señal x #b", ["señal", "b"]), (tx.mentions, "@a.b @c", ["a.b", "c"]), (tx.emojis, "a😀b🚀", "😀🚀"), (tx.truncate, "x" * 101, "x" * 97 + "..."), (tx.preview, "x" * 101, "x" * 100 + "..."),
        (tx.clean_nfkc, "ﬁ​ x", "fi x"), (tx.preprocess_comment, "Hola @ana http://x.y Z", "hola z"), (tx.urls, "a https://x.y b", ["https://x.y"]),
        (counts.extract_numbers, "a1b22", [1, 22]), (counts.first_number, "a month", 1), (counts.rating, "4,5 stars", 4.5), (counts.price_level, "$$ cheap", "$$"),
        (safety.mask_log, "password=abcdef x token: zz", "password=abc*** x token: ***"), (safety.error_category, "Too many requests", "rate_limit"), (safety.mask_credential, "ab", "**"),
    ]:
        assert one(spark, f(v), v=given_) == want, (f, given_)
    assert one(spark, tx.jaccard(tx.words(F.lit("a b")), tx.words(F.lit("B c")))) == pytest.approx(1 / 3)
    assert one(spark, tx.jaccard(tx.words(F.lit("")), tx.words(F.lit("")))) == 0
    assert one(spark, safety.block_phrase(F.lit("Please WAIT a minute"), "instagram")) == "please wait"
    assert one(spark, safety.mask_map(F.create_map(F.lit("api_key"), F.lit("abcdef"), F.lit("name"), F.lit("n")))) == {"api_key": "abc***", "name": "n"}


def test_dates(spark):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    assert one(spark, dates.relative_post(F.lit("december 5"), now)) == datetime.datetime(2023, 12, 5)
    assert one(spark, dates.relative_post(F.lit("3 h"), now)) == datetime.datetime(2024, 3, 1, 9)
    assert one(spark, dates.relative_token(F.lit("2mo"), compat=False)) == "2mo"
    assert one(spark, dates.formatted(now, "human")) == "Mar 01, 2024 12:00 PM"
    assert one(spark, dates.formatted(now, "iso", zone="America/Asuncion")) == "2024-03-01T09:00:00"


def test_paths():
    assert safety.within("/b", "c", "d.json") == "/b/c/d.json"
    for bad in ("../x", "/x", "~x", "a/../../x"):
        with pytest.raises(ValueError):
            safety.within("/b", bad)


def table(spark, rows):
    return spark.createDataFrame(rows, "seq long, client string, platform string, platform_id string, text string")


def test_first_writer_wins_over_all_clients(spark):
    old = table(spark, [(1, "a", "f", "x", "t")])
    new = table(spark, [(2, "b", "f", "x", "u"), (3, "b", "f", "y", "u"), (4, "b", "f", "y", "v"), (5, None, "f", "z", "v")])
    added = store.insert_ignore(old, new, required=("client",))
    assert [r.seq for r in added.collect()] == [3]
    assert store.insert_ignore(old.union(added), new, required=("client",)).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from("ab"), st.sampled_from(["s", "t", ""])), max_size=12))
def test_properties(spark, rows):
    df = table(spark, [(i, c, "f", str(k), t) for i, (k, c, t) in enumerate(rows)])
    once = store.keep_first(df, ["text"], ["seq"])
    assert sorted(store.keep_first(once, ["text"], ["seq"]).collect()) == sorted(once.collect())
    assert sorted(store.merge_comments(df, df.limit(0)).collect()) == sorted(df.collect())
    assert store.merge_comments(df, df).count() == df.count()


def test_repeats_inside_a_new_batch_stay(spark):
    old, new = table(spark, [(1, "a", "f", "x", "t")]), table(spark, [(2, "a", "f", "y", "t"), (3, "a", "f", "y", "t"), (4, "a", "f", "x", "t")])
    assert sorted(r.seq for r in store.merge_comments(old, new).collect()) == [1, 2, 3]


def test_threads(spark):
    rows = [("p", 0, "@x hi", 0), ("p", 1, "first", 10), ("p", 2, "", 10), ("p", 3, "reply", 60), ("p", 4, "next", 12), ("q", 0, "alone", 5)]
    d = spark.createDataFrame(rows, "post_id string, idx int, text string, offset_left int")
    got = {r.comment_id: (r.parent_id, r.depth) for r in threads.by_offset(d).collect()}
    assert got == {"p_c0": (None, 2), "p_c1": (None, 1), "p_c3": ("p_c1", 2), "p_c4": (None, 1), "q_c0": (None, 1)}
    flags = spark.createDataFrame([("p", 2, "a", False), ("p", 5, "b", True)], "post_id string, idx int, text string, is_reply boolean")
    assert [(r.comment_id, r.parent_id) for r in threads.by_flag(flags, compat=True).orderBy("idx").collect()] == [("p_0", None), ("p_1", "p_c2")]
    assert {r.comment_id: r.replies_count for r in threads.reply_counts(threads.by_flag(flags)).collect()} == {"p_c2": 1, "p_c5": 0}


def test_validation(spark):
    d = spark.createDataFrame([("", "p", "t", -1), ("i", "p", None, 1)], "platform_id string, post_id string, text string, likes int")
    a, b = validate.comments(d).orderBy("likes").collect()
    assert a.errors == ["missing platform_id", "negative likes"] and not a.is_valid and b.warnings == ["empty text"] and b.is_valid
    assert not validate.comments(d, strict=True).orderBy("likes").collect()[1].is_valid
    v = spark.createDataFrame([(1, True), (2, False), (3, True)], "n int, is_valid boolean")
    assert [r.n for r in validate.before_first_invalid(v, "n").collect()] == [1]
    h = spark.createDataFrame([(12, 1, 1.0, 1.0), (6, 0, 0.1, 0.1)], "containers int, comments int, text_rate double, author_rate double")
    assert [r.alerts for r in validate.health(h).collect()] == [["few comments"], ["no comments", "few texts", "few authors"]]


def test_quality_keeps_its_quirk(spark):
    c = spark.createDataFrame([("hello world", "ann"), ("hello there", "bob")], "text string, author_username string").withColumn("published_at", F.lit(None).cast("timestamp"))
    rates = validate.comment_rates(c)
    assert validate.quality(rates, F.lit(1), F.lit(0)).first().score == 80
    assert validate.quality(rates, F.lit(1), F.lit(0), compat=False).first().score == 100


def test_limits(spark):
    rows = [(1, i, "success") for i in range(10)] + [(2, 0, "rate_limit"), (2, 1, "error"), (3, 0, "error"), (3, 1, "error")]
    d = spark.createDataFrame(rows, "k int, at int, o string")
    got = {r.k: (r.delay_ms, r.may_continue) for r in metrics.adaptive_delay(d, "k", "at", "o").collect()}
    assert got == {1: (1800, True), 2: (3600, True), 3: (2400, True)}
    assert one(spark, metrics.metric_key(F.lit("n"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "n{a=1,b=2}"


def test_stops(spark):
    d = spark.createDataFrame([(i, i in (2, 4, 5)) for i in range(8)], "i int, f boolean")
    assert [r.i for r in query.until_known(d, "i", "f", 3).collect()] == [0, 1, 2, 3, 4]
    assert sorted(r.i for r in query.until_failures(d, "i", "f", 2).collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        query.page(d, [F.col("i")], 1, 501)


def test_similarity(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "x y"), (4, "D c b A")], "seq int, text string")
    assert [(r.a, r.b, round(r.similarity, 2)) for r in similarity.jaccard_pairs(d, 0.6).collect()] == [(1, 2, 0.6)]
    assert {(r.a, r.b) for r in similarity.minhash_pairs(d, 0.9).collect()} == {(1, 4)}
    v = spark.createDataFrame([(1, [1.0, 0.0], "g"), (2, [0.9, 0.1], "g"), (3, [0.0, 1.0], "g")], "vec_id int, embedding array<double>, label string")
    assert {r.vec_id: r.leader for r in similarity.condense(v, 0.8, "label").collect()} == {1: 1, 2: 1, 3: 3}
    assert similarity.representatives(v, "label").first().vec_id == 2


def test_members_of_word_sets(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, None), (4, "D c b A"), (5, "a b c d a"), (6, "a b c d"), (7, " ")], "seq int, text string")
    assert sorted((r.seq, r.set_id) for r in similarity.word_set_members(d).collect()) == [(1, 1), (2, 2), (4, 1), (5, 1), (6, 1)]


def test_gate_measures_its_figures(spark):
    rows = [(f"{i}", "p1", f"text number {i}", "good", "x", 1) for i in range(8)] + [(f"{i}", "p1", "the same text", "copies", "x", 1) for i in range(8)]
    rows += [(None if i < 2 else f"{i}", "p1", f"text number {i}", "invalid", None, 1) for i in range(8)] + [("1", None, "a text", None, "x", 1)]
    d = spark.createDataFrame(rows, "platform_id string, post_id string, text string, client string, author_username string, likes int").withColumn("published_at", F.lit(None).cast("timestamp"))
    got = {r.client: r for r in validate.measured_gate(d, "client").collect()}
    assert {k: r.failures for k, r in got.items()} == {"good": [], "copies": ["duplicate_rate", "score"], "invalid": ["valid_rate", "author_rate", "score"], None: ["valid_rate"]}
    assert (got["copies"].duplicate_rate, got["invalid"].valid_rate, got[None].score) == (0.875, 0.75, 75)


def test_consistency_and_trend(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.0), (2, "a", 1.0), (3, "a", 0.5), (3, "b", 0.6)], "author_id int, platform string, score double")
    assert {r.author_id: r.consistent for r in commenters.consistency(d).collect()} == {1: False, 2: None, 3: True}


def test_exports(spark, tmp_path):
    rows = [("1", "f", "hi", ("u", "ann"), datetime.datetime(2024, 1, 2, 3, 4, 5), 0, []), ("2", "f", "", ("v", ""), None, 5, ["m"])]
    d = spark.createDataFrame(rows, "id string, platform string, text string, author struct<platform_id: string, username: string>, published_at timestamp, likes int, media array<string>")
    assert export.project(d, export.preset("minimal")).columns == ["id", "platform", "text", "published_at", "likes", "author_username"]
    lines = [json.loads(r.value) for r in export.json_lines(d, export.preset("streaming"), "comment").collect()]
    assert [*lines[0]][0] == "type" and lines[0]["likes"] == 0 and "media" not in lines[0] and "text" not in lines[1] and "published_at" not in lines[1]
    doc = json.loads(export.json_document(d, export.preset("readable"), "acme", F.lit("now")).first().value)
    assert doc["metadata"]["total_comments"] == 2 and len(doc["comments"]) == 2
    for fmt in ("JSONL", "json", "csv", "parquet"):
        path = export.write(d, fmt, str(tmp_path), fmt.lower())
        assert spark.read.text(path).count() >= 2 if fmt != "parquet" else spark.read.parquet(path).count() == 2
    for bad in (lambda: export.write(d, "xml", str(tmp_path)), lambda: export.preset("none")):
        with pytest.raises(ValueError):
            bad()
    name = export.file_name(F.lit("Acme"), F.array(F.lit("X"), F.lit("fb")), F.lit("comments"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.lit("json"))
    assert one(spark, name) == "acme_fb_x_comments_20240102_030405.json"


def test_files(spark, tmp_path):
    (tmp_path / "a_posts.json").write_text(json.dumps({"posts": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "b_posts.json").write_text("{broken")
    assert sorted(r.id for r in files.known_ids(spark, f"{tmp_path}/*_posts.json").collect()) == ["1", "2"]
    config = {"companies": [{"id": "c", "name": "old", "industry": "t", "country": "p", "accounts": []}, {"id": "c", "name": "new", "industry": "t", "country": "p", "accounts": [{"platform": "f", "identifier": "i", "enabled": True}]}]}
    (tmp_path / "companies.json").write_text(json.dumps(config))
    assert [(r["name"], r.identifier) for r in files.companies(spark, f"{tmp_path}/companies.json").collect()] == [("new", "i")]
    (tmp_path / "progress.txt").write_text(json.dumps({"processed_post_ids": ["7", "8", "7"]}))
    assert sorted(r.id for r in files.checkpoint_ids(spark, f"{tmp_path}/progress.txt").collect()) == ["7", "8"]
    lines = spark.createDataFrame([("START|a|x", 1), ("COMMIT|a|x", 2), ("START|b|x", 3), ("odd", 4)], "value string, line_no int")
    assert [r.op_id for r in files.incomplete(lines).collect()] == ["b"]
    assert files.listing(spark, str(tmp_path), "*.json").count() == 3 and files.checksums(spark, str(tmp_path)).count() == 4


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(i % 3, i % 5, datetime.datetime(2024, 1, 1, i % 24)) for i in range(60)]
    spark.createDataFrame(rows, "k int, o int, ts timestamp").write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    got = {}
    handlers = {"bad": lambda df, n: 1 / 0, "good": lambda df, n: got.update(rows=got.get("rows", 0) + df.count())}
    events.fan_out(events.read(spark, f"{tmp_path}/in", batch.schema), handlers, f"{tmp_path}/cp").awaitTermination()
    assert got["rows"] == 60
    events.to_parquet(events.new_rows(events.read(spark, f"{tmp_path}/in", batch.schema), "ts", "10 days", "k", "o"), f"{tmp_path}/out", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.dropDuplicates(["k", "o"]).count()


def test_ingest_twice_adds_nothing(spark, tmp_path):
    from threadmill.operators import ingest

    ddl = "seq bigint, client string, platform string, platform_id string, text string"
    new = table(spark, [(1, "a", "f", "x", "t"), (2, "a", "g", "x", "t"), (3, "b", "f", "x", "u")])
    assert ingest.append(spark, f"{tmp_path}/t", new, ddl).count() == 2
    assert ingest.append(spark, f"{tmp_path}/t", new, ddl).count() == 2
    raw = spark.createDataFrame([("p", "ann", 3)], "post_id string, author string, rating int")
    r = ingest.comments(raw).first()
    assert (r.platform_id, r.text, r.likes, r.author.username) == ("p_unknown", "", 0, "ann") and json.loads(r.raw_data)["rating"] == 3
    a = ingest.author({"user_id": F.lit("7"), "username": F.lit(""), "screen_name": F.lit("ann")})
    assert one(spark, a).asDict() == {"platform_id": "7", "username": "ann", "display_name": None, "profile_url": None, "profile_image": None}


def test_density_clusters(spark):
    v = spark.createDataFrame([(i, [1.0, i / 100], "g") for i in range(4)] + [(9, [0.0, 1.0], "g")], "vec_id int, embedding array<double>, label string")
    assert {r.vec_id: r.cluster for r in similarity.dbscan(v, 0.1, 3, "label").collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: -1}


def test_command_line(capsys):
    from threadmill.__main__ import main

    main(["list-formats"])
    assert capsys.readouterr().out.split() == ["csv", "json", "jsonl", "parquet"]
