import random
import tracemalloc
import zlib

import numpy as np

from threadmill.llm import langid

LETTERS = {"en": "theandofin", "xx": "žšůýáíéqwk", "fr": "éèàleuxoir"}


def documents(spark, n=240):
    r = random.Random(5)
    rows = []
    for i in range(n):
        lang = r.choice([*LETTERS])
        rows.append((i, " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(40)), lang, "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    df = documents(spark)
    truth = {r.doc_id: r.lang for r in df.collect()}
    got = langid.held_out(df).collect()
    assert len(got) == 240
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert sum(truth[r.doc_id] == r.lang_pred for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)


def test_only_training_texts_teach(spark):
    df = documents(spark)
    other = df.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'zz' ELSE lang END AS lang", "score")
    assert sorted(map(tuple, langid.held_out(df).collect())) == sorted(map(tuple, langid.held_out(other).collect()))


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %% 34", "fr"), (4, "the and of in", None), (None, "the thean", "en"), (5, "a", "en"), (5, "a", "en"), (6, "the and " * 20000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.held_out(df).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (6, "en")} <= got
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.held_out(df.where("lang is null")).collect())
    assert langid.held_out(df.limit(0)).count() == 0
    kept = langid.accept(df)
    assert kept.columns == df.columns and kept.count() == 5


def test_vectors_bind_by_place():
    a, b = langid._vectors(langid._ngrams("ab")[0]), langid._vectors(langid._ngrams("ba")[0])
    assert set(abs(a).ravel()) == {1.0} and (a != b).any()


def test_prototypes_and_cosines_match_brute_force(spark):
    df = documents(spark, 60)
    rows = df.collect()

    def vector(text):
        code = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in code:
            code = code.replace("  ", " ")
        total = np.zeros(langid.SIZE)
        for k in range(len(code) - 2):
            a, b, c = (langid._letter(ord(x)).astype(int) for x in code[k : k + 3])
            total += np.roll(a, 2) * np.roll(b, 1) * c
        return total

    vectors = {r.doc_id: vector(r.text) for r in rows}
    prototypes = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + vectors[r.doc_id]
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for x in langid.held_out(df).collect():
        want = {lang: cosine(vectors[x.doc_id], p) for lang, p in prototypes.items()}
        best = max(sorted(want), key=want.get)
        assert x.lang_pred == best and abs(x.score - want[best]) < 1e-9


def test_memory_does_not_grow_with_distinct_letters():
    r = np.random.default_rng(3)
    text = "".join(chr(c) for c in r.integers(0x4E00, 0x5A00, 150_000))
    tracemalloc.start()
    found = langid._ngrams(text)
    total = langid._bundle([found], [0], 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and np.abs(total).max() > 0


def test_stage_rejects_what_no_language_knows(spark):
    df = documents(spark)
    r = random.Random(8)
    odd = [(900 + i, " ".join("".join(r.choice("ღამეთშვილ") for _ in range(4)) for _ in range(40)), "en", "s") for i in range(3)] + [(950, "12 %", "en", "s"), (951, None, None, None)]
    got = {x.doc_id for x in langid.accept(df.unionByName(spark.createDataFrame(odd, df.schema))).collect()}
    assert len(got & {*range(240)}) >= 239 and not got & {900, 901, 902, 950, 951}
    nothing = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "score").unionByName(spark.createDataFrame(odd, df.schema).selectExpr("doc_id", "text", "cast(null as string) as lang", "score"))
    assert langid.accept(nothing).count() == 243


def test_columns_may_clash(spark):
    df = documents(spark, 40).withColumnsRenamed({"score": "row"}).selectExpr("*", "1 as size", "'x' as lang_pred", "0.5 as score")
    kept = langid.accept(df)
    assert kept.columns == df.columns and kept.count() >= 39
