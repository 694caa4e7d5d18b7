import hashlib
import random
import re

from threadmill.llm import fim


def brute(doc_id, text):
    """Output, form and characters of the parts by the definition, one document at a time."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, output string, k1 int").repartition(parts)
    got = sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in fim.transform(df).collect()), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in rows), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((x.doc_id, x.output_sha256, x.restored_sha256) for x in fim.digests(df).collect()), key=str)
    assert got == sorted(((i, sha(brute(i, t)[4]), sha(t or "")) for i, t in rows), key=str)


def test_outputs_match_brute_force(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice(["ab", "Zq", "é", "漢", "😀", " ", "\n", "<", "<P", "S>", ">", "<M", "1", "\x00", "á"]) for _ in range(n))
    check(spark, [(i, text(r.choice([0, 1, 2, 5, 40, 200]))) for i in range(-20, 300)])


def test_marks_nulls_repeats_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "a <P> b"), (4, "<S>"), (5, "x<M>"), (6, "<"), (6, "other text"), (None, "some words"), (None, None), (7, "long Text, 1 é " * 20_000), (8, "w" * 300_000)]
    check(spark, rows + [(9, "hot row, again and again")] * 200)


def test_empty_table_and_parameters(spark):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "id long, body string")
    assert fim.transform(df.limit(0), "id", "body").count() == 0
    assert {x.form for x in fim.transform(df, "id", "body", plain_percent=0).collect()} == {"plain"}
    assert {x.form for x in fim.transform(df, "id", "body", plain_percent=100, spm_percent=100).collect()} == {"spm"}
    assert fim.transform(df, "id", "body").columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_units_move_only_with_their_texts(spark):
    """The window, the join and the aggregate over units add no exchange of units to that of the texts."""
    spark.conf.set(fim._PART_OF_KEYS, "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id long, text string")
        rows = fim._rows(df, "doc_id", "text")
        plan = fim.offsets(rows, fim.requests(rows, 90, 20))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(fim._PART_OF_KEYS)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate posexplode" in plan and plan.count("Exchange hashpartitioning(k1") <= 2 and plan.count("Exchange hashpartitioning(j1") <= 1
