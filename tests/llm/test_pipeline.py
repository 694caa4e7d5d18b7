import random

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
from threadmill.llm import nearcopies


def test_pipeline_keeps_clean_documents_and_drops_the_rest(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("theandofinrs") for _ in range(r.randint(2, 7)))
    clean = [(i, " ".join(word() for _ in range(80)), "en", f"s{i % 3}") for i in range(40)]
    passage = " ".join(word() for _ in range(60))
    rows = clean + [(100, clean[5][1], "en", "s0"), (101, "12 %%", "en", "s1"), (102, None, None, None), (103, "own words here " + passage, "en", "s1"), (104, passage + " other words there", "en", "s2")]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[x.doc_id] = t.decode(np.frombuffer(x.ids, "<u4").tolist(), skip_special_tokens=False)
    # 104 shares 56 of 62 shingles with 103, and so is its near copy.
    assert set(got) == {*range(40), 103}
    assert all(got[i] == text for i, text, _, _ in clean) and got[103] == "own words here " + passage
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_registered():
    names = [*__spark_entry__.queries()]
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages_keep_extra_columns_and_clean_up(spark, tmp_path):
    from threadmill.llm import common

    r = random.Random(10)
    word = lambda: "".join(r.choice("theandofinrs") for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(60)), "en", f"s{i % 3}", 1, i, "g", [1], 2.0, "k", 3) for i in range(20)] + [(99, "word " * 40_000, "en", "s0", 1, 1, "g", [1], 2.0, "k", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, gone long, seeds_id string, firsts_at array<int>, position double, key string, block int")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns, name
    assert {x.doc_id for x in docs.collect()} == {*range(20), 99}
    common.clean(spark)


def near_pairs(rows, words=5, threshold=0.8):
    """All pairs of shingle sets of at least this similarity, by an exact search."""
    sets = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        if w:
            sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1)))
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    found = set()
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in where[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        found |= {(i, j) for j, n in common.items() if n >= threshold * (len(s) + len(sets[j]) - n)}
    return found


def test_near_copies_against_an_exact_search(spark):
    """Of all pairs with a similarity of 0.8 or more at least nine in ten meet in a group, and no group is larger than its links make it."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
    pairs = near_pairs(rows)
    got = {x.id: x.group for x in nearcopies.groups(df).collect()}
    assert len(pairs) > 30 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert all(find(i) == find(g) for i, g in got.items())
    left = {x.doc_id for x in corpus_pipeline.one_of_each_group(spark, df, "").select("doc_id").collect()}
    assert len({i for i, j in pairs if i in left and j in left}) <= 0.1 * len(pairs) and len(left) < len(rows)


def test_near_copies_edges(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "a b"), (2, "A  b"), (3, None), (4, ""), (None, "a b"), (5, long), (6, long + " more"), (7, "other words of the same length as these"), (7, "a b")]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, gone int, s string")
    left = nearcopies.dedup(df)
    assert left.columns == df.columns and sorted(str(x.doc_id) for x in left.collect()) == ["1", "3", "4", "5", "None"]
    assert nearcopies.dedup(df.limit(0)).count() == 0


def test_no_near_copies_are_left(spark):
    """Documents that are just similar enough share no band as often as not; none is left beside another, and nothing else is lost."""
    r = random.Random(12)
    rows = []
    for _ in range(120):
        base = [f"w{r.randint(0, 99_999)}" for _ in range(140)]
        for k in range(3):  # three changed words in 140 cost 15 of 136 shingles
            copy = list(base)
            for at in (20, 70, 120)[:k and 2 + r.randint(0, 1)]:
                copy[at + r.randint(-5, 5)] = f"n{r.randint(0, 99_999)}"
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pairs = near_pairs(rows)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert len(pairs) > 150
    assert {x.id: x.group for x in nearcopies.groups(df).collect()} == {i: find(i) for i, _ in rows}
    assert {x.doc_id for x in nearcopies.dedup(df).collect()} == {i for i, _ in rows if find(i) == i}
