import random

import pytest

from threadmill.operators import setjoin, similarity


def plain(sets, threshold):
    return {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}


@pytest.mark.parametrize("threshold,tiles", [(0.7, {}), (0.5, {"block": 150, "slice_": 400}), (0.8, {"block": 300, "slice_": 300}), (0.3, {"block": 1000, "slice_": 200})])
def test_all_pairs_are_found(spark, threshold, tiles):
    """Sets of 1 to 60 words of which some are changed copies, in many small tiles."""
    r = random.Random(7)
    sets = {}
    for _ in range(90):
        base = {f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(r.choice([1, 2, 5, 20, 60]))}
        for _ in range(r.choice([1, 2, 4])):
            rate = r.choice([0.01, 0.03, 0.3])
            sets[len(sets)] = frozenset({w if r.random() > rate else f"n{r.randint(0, 999)}" for w in base})
    rows = {s: i for i, s in reversed(sets.items())}
    want = plain({i: s for s, i in rows.items()}, threshold)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, w array<string>").repartition(3)
    got = [(x.a, x.b) for x in setjoin.pairs(df, threshold, **tiles).collect()]
    assert len(want) > 5 and len(got) == len(set(got)) and set(got) == want


def test_random_pairs_leave_no_task(spark):
    """Sets that share a rare word or two and nothing else are no candidates, however many they are."""
    r = random.Random(3)
    rows = [(i, [f"w{r.randint(0, 2000)}" for _ in range(60)]) for i in range(400)]
    df = spark.createDataFrame([(i, sorted({*w})) for i, w in rows] + [(1000, sorted({*rows[0][1], "other"}))], "id long, w array<string>")
    found = setjoin.candidates(setjoin.prefixes(setjoin.keyed(df), 0.7), 0.7)
    assert (0, 1000) in {(x.a, x.b) for x in found.collect()} and found.count() < 20


def test_pairs_that_share_half_leave_no_task(spark):
    """Sets of 60 of the same 90 words meet in their prefixes, all with all, but differ by far too much."""
    r = random.Random(5)
    rows = [(i, sorted(r.sample([f"w{k}" for k in range(90)], 60))) for i in range(200)]
    rows += [(1000 + i, sorted({*w[1:], "other"})) for i, w in rows[:50]]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    want = plain({i: {*w} for i, w in rows}, 0.7)
    found = {(x.a, x.b) for x in setjoin.candidates(setjoin.prefixes(setjoin.keyed(df), 0.7), 0.7).collect()}
    assert want <= found and len(want) >= 50 and len(found) < len(want) + 200


def test_empty_and_texts(spark):
    none = spark.createDataFrame([(1, None), (2, " ")], "seq string, text string")
    assert similarity.jaccard_pairs(none, 0.7).count() == 0
    some = spark.createDataFrame([("b", "X y z v"), ("a", "x y z w v"), ("c", "v z y x"), ("d", None)], "seq string, text string")
    assert [tuple(x) for x in similarity.jaccard_pairs(some, 0.7).collect()] == [("a", "b", 0.8)]


def test_minhash_drops_no_pair_that_is_similar(spark):
    """With enough bands of one hash all pairs meet: what sizes and parities rule out has too low a similarity, and copies hang on the first."""
    r = random.Random(9)
    base = [[f"w{r.randint(0, 9999)}" for _ in range(n)] for n in (3, 20, 150, 700, 2000)]
    sets = {}
    for words in base:
        for rate in (0, 0.05, 0.1, 0.15, 0.2, 0.4):
            sets[len(sets)] = frozenset(w if r.random() >= rate else f"n{r.randint(0, 99999)}" for w in words)
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    want = plain({i: s for s, i in first.items()}, 0.7)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(100, sorted(sets[0]))], "id long, w array<string>")
    got = {(x.a, x.b): x.similarity for x in setjoin.minhash(df, 0.7, 60, 1).collect()}
    assert len(want) > 10 and {k for k in got if got[k] < 1} == want and got[0, 100] == 1
    hashed = setjoin.keyed(df)
    assert hashed.columns == ["id", "k", "h"], "no text goes to where bands meet"


def copies(r, groups, most):
    """Sets of which some are changed copies of others, a first group of so many."""
    sets = {}
    for g in range(groups):
        base = [f"w{r.randint(0, 9999)}" for _ in range(r.choice([8, 40, 300, 600]))]
        for _ in range(most if g == 0 else r.choice([1, 2, 5])):
            rate = r.choice([0.01, 0.05, 0.1])
            sets[len(sets)] = frozenset(w if r.random() > rate else f"n{r.randint(0, 99_999)}" for w in base)
    return sets


def test_prefixes_leave_out_words_that_occur_once(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "own"]), (2, ["a", "b", "c", "other"]), (3, ["lonely"])], "id long, w array<string>")
    assert {x.id: len(x.p) for x in setjoin.prefixes(setjoin.keyed(df), 0.5).collect()} == {1: 2, 2: 2, 3: 0}


def test_a_set_goes_to_few_tiles(spark, monkeypatch):
    """The check of a large group's pairs, in tiles of any size, is the plain search's, and no join carries the words of a pair's sets."""
    sets = copies(random.Random(13), 20, 60)
    rows = {s: i for i, s in reversed(sets.items())}
    want = plain({i: s for s, i in rows.items()}, 0.7)
    df = spark.createDataFrame([(i, " ".join(s)) for i, s in sets.items()], "id long, text string").repartition(3)
    for pairs, most, words in ((1 << 17, 1 << 12, 1 << 22), (50, 7, 1), (1000, 4, 5000)):
        monkeypatch.setattr(setjoin, "_PAIRS", pairs)
        monkeypatch.setattr(setjoin, "_SETS", most)
        monkeypatch.setattr(setjoin, "_CHECKED", words)
        found = setjoin.pairs(df, 0.7, block=3000, slice_=3000)
        got = {(x.a, x.b): x.similarity for x in found.collect()}
        assert got.keys() == want and len(want) > 500
        assert all(got[a, b] == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in want)
        assert "array_intersect" not in found._jdf.queryExecution().toString()


def test_ids_that_are_shared_and_long_sets(spark):
    """Every set of an id counts, and sets of some thousand words have parities of their own length."""
    r = random.Random(17)
    long = [f"w{k}" for k in range(3000)]
    some = [r.sample(long, 2700) for _ in range(6)]
    df = spark.createDataFrame([("a", "x y z v"), ("a", " ".join(some[0])), ("b", "v z y x u"), ("b", "p q r"), *[(f"c{i}", " ".join(x)) for i, x in enumerate(some[1:])], (None, "x y z"), ("d", None), ("e", " \n")], "id string, text string")
    got = {(x.a, x.b) for x in setjoin.pairs(df, 0.7).collect()}
    assert got == {("a", "b")} | {(x, y) for x in ("a", *[f"c{i}" for i in range(5)]) for y in [f"c{i}" for i in range(5)] if x < y}


def test_hashed_texts_have_the_words_of_the_column_function(spark):
    from pyspark.sql import functions as F

    from threadmill.functions.text import words

    texts = ["A b a", " lead and\ttrail\x0b\x0c\r\n", "ÜBER über x İ ΟΔΟΣ", "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " " + "x" * 66, "a b", "ab ba aab \x1c\x85", "﻿ 1 2 3", "ß SS ss", None, "", "\t "]
    df = spark.createDataFrame([*enumerate(texts)], "id long, text string").repartition(1)
    want = {x.id: [str(w) for w in x.w] for x in df.select("id", words(F.col("text")).alias("w")).collect() if x.w}
    got = {x.id: x.h for x in setjoin.texts(df).of(df.select("id")).collect()}
    assert got.keys() == want.keys()
    hashes = lambda w: int(setjoin.word_hashes([w.encode()])[0].astype("int64")[0])
    assert all({hashes(w) for w in want[i]} == set(h) and len(h) == len(want[i]) for i, h in got.items())
    assert len({hashes(w) for x in want.values() for w in x}) == len({w for x in want.values() for w in x})
