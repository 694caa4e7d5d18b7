import random

import numpy as np
from pyspark.sql import functions as F

from threadmill.operators import neardup, similarity


def variants(r, n):
    """Texts of which some are changed copies of others, and what a plain search finds."""
    rows, at = [], 0
    for _ in range(n):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(20, 60))]
        for _ in range(r.choice([1, 1, 2, 3])):
            copy = [w if r.random() > r.choice([0, 0.02, 0.06]) else f"n{r.randint(0, 9999)}" for w in base]
            rows.append((at, " ".join(copy)))
            at += 1
    r.shuffle(rows)
    return rows


def plain_groups(rows, threshold):
    sets = {i: frozenset(t.split()) for i, t in rows if t and t.split()}
    near = {i: [j for j in sets if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sorted(sets):
        stack = [] if i in out else [i]
        while stack:
            k = stack.pop()
            if k not in out:
                out[k] = i
                stack += near[k]
    return out, [(i, j) for i in near for j in near[i] if i < j]


def test_groups_and_recall(spark):
    r = random.Random(5)
    rows = variants(r, 150)
    rows += [(5000 + k, "one text that is copied again and again") for k in range(300)] + [(6000, None), (6001, " "), (6002, "lonely")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "seq long, text string, s int").repartition(4)
    got = {x.seq: x.group for x in similarity.minhash_groups(df, 0.7).collect()}
    want, pairs = plain_groups(rows, 0.7)
    assert got.keys() == want.keys()
    met = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 300 and met >= 0.95 * len(pairs)
    assert all(want[i] == want[g] for i, g in got.items()), "nothing is linked that a plain search does not link"
    assert similarity.minhash_groups(df.limit(0)).count() == 0


def test_recall_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("seq"), F.lower("text").alias("text"))
    want, pairs = plain_groups([tuple(x) for x in df.collect()], 0.7)
    got = {x.seq: x.group for x in similarity.minhash_groups(df, 0.7).collect()}
    assert len(pairs) > 5 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)


def test_band_keys_follow_the_set():
    x = np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64)
    assert (neardup.band_keys(x, 5, 3) == neardup.band_keys(x[::-1].copy(), 5, 3)).all() and len(set(neardup.band_keys(x, 20, 3).tolist())) == 20


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (3, "e f g h")], "seq long, text string")
    assert {(x.seq, x.group) for x in similarity.minhash_groups(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_band_keys_are_the_minima_of_each_function(monkeypatch):
    """Functions are applied many at once; in pieces of any size the keys stay what one function after the other gives."""
    x = np.random.default_rng(2).integers(0, 1 << 63, 70, np.uint64) * np.uint64(2)
    low = np.array([(((x ^ (x >> np.uint64(29))) * f + s) >> np.uint64(3)).min() for f, s in zip(neardup._FACTORS[:21], neardup._SHIFTS)], np.uint64).reshape(7, 3)
    key = np.arange(7, dtype=np.uint64)
    for r in range(3):
        key = (key ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    for cells in (1, 70, 300, 1 << 14):
        monkeypatch.setattr(neardup, "_CELLS", cells)
        assert (neardup.band_keys(x, 7, 3) == key.view(np.int64)).all()


def test_no_link_is_left_out(spark):
    """Sets that are alike but share no band, or meet only under smallest ids that are like neither, are linked all the same: the result is the plain search's."""
    r = random.Random(11)
    rows = []
    for _ in range(150):
        base = r.sample(range(4000), 30)
        for _ in range(3):  # 27 of 33 words in common at most, 0.7 and little more in most pairs
            rows.append((len(rows), " ".join(f"w{w}" for w in [*r.sample(base, 27), *r.sample(range(4000, 90_000), r.choice([2, 3]))])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, text string").repartition(4)
    want, pairs = plain_groups(rows, 0.7)
    assert len(pairs) > 100
    assert {x.seq: x.group for x in similarity.minhash_groups(df, 0.7).collect()} == want
    few = {x.seq: x.group for x in similarity.minhash_groups(df, 0.7, bands=1, rows=8).collect()}
    assert few == want, "whatever the bands miss, the join finds"
