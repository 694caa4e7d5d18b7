import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from threadmill.llm import kdtree, mixing, topk


def documents(spark, n=800):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(1, 40), r.choice(["en", "en", "fr"]), "hot" if i % 3 == 0 else f"s{i % 5}", r.randint(1, 100), i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long").repartition(4)


def test_shards_are_even_and_slots_gapless(spark):
    df = documents(spark)
    text = {r.doc_id: r.text for r in df.collect()}
    got = kdtree.eight_shards(df).collect()
    slots, bytes_ = defaultdict(list), Counter()
    for x in got:
        assert x.size == len(text[x.doc_id]) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) and x.law == "bytes" and x.grown_shard is None
        slots[x.shard].append(x.slot)
        bytes_[x.shard] += x.size
    assert sorted(slots) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(bytes_.values()) - min(bytes_.values()) <= 4 * 81
    assert sorted(map(tuple, got)) == sorted(map(tuple, kdtree.eight_shards(df.repartition(7)).collect()))


def test_shards_by_target_and_edges(spark):
    df = documents(spark, 100)
    total = sum(len(r.text) + 1 for r in df.collect())
    assert {x.shard for x in kdtree.shards(df, target_bytes=total // 3 + 1).collect()} == {0, 1, 2}
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, None), (1, "", "en", None, None), (2, "é" * 5000, None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.size for x in kdtree.eight_shards(odd).collect()) == [1, 1, 1, 10001]
    assert kdtree.eight_shards(odd.limit(0)).count() == 0


def test_mixture_meets_its_budget(spark):
    df = documents(spark)
    mix = mixing.Mix(df, block_tokens=256)
    plan = {x.source: x for x in mix.sources.collect()}
    w = np.array([x.weight for x in plan.values()])
    alpha = next(iter(plan.values())).alpha
    p = np.array([x.tokens for x in plan.values()], float)
    p /= p.sum()
    assert 0 < alpha < 1 and np.allclose(w, p**alpha / (p**alpha).sum(), atol=1e-6)
    entropy = lambda a: -(v := p**a / (p**a).sum()) @ np.log(v)
    assert entropy(alpha) >= 0.95 * np.log(len(p)) > entropy(alpha + 1e-4)
    drawn, once = Counter(), defaultdict(Counter)
    for x in mix.drawn(mix.rows).collect():
        drawn[x.source] += x.tokens
        once[x.source][x.id, x.epoch] += 1
    for s, x in plan.items():
        assert max(once[s].values()) == 1
        assert {i for i, _ in once[s]} == {r.doc_id for r in df.collect() if r.source == s}
        assert 0 <= x.budget - drawn[s] <= 40
    assert mixing.schedule(df).count() == mixing.mixed(df).count()


def test_repetition_limit(spark):
    sizes = spark.createDataFrame([("a", 1_000_000), ("b", 1_000), ("c", 1_000)], "source string, tokens long")
    free, held = (mixing.weights(sizes, entropy=0.9, max_repeats=m).collect() for m in (1e9, 4.0))
    assert max(x.budget / x.tokens for x in free) > 100 and 3.9 < max(x.budget / x.tokens for x in held) <= 4.001


def test_mixing_edges(spark):
    odd = spark.createDataFrame([(None, None, None), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (3, "z " * 30000, None)], "doc_id long, text string, source string")
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(odd).count() >= 5
    assert mixing.schedule(odd.limit(0)).count() == 0


def test_many_sources_are_split_in_parts(spark, monkeypatch):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else f"s{i % 5}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small = sorted(mixing.schedule(df).collect())
    monkeypatch.setattr(mixing, "_MOST_SOURCES", 1)
    assert sorted(mixing.schedule(df).collect()) == small and len(small) >= 120


def brute(rows, k=20):
    whole = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows}
    out = []
    for q, v in whole.items():
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_k_matches_brute_force(spark, scale):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in np.round(r.normal(size=6), 1) * scale]) for i in r.permutation(180)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.every_twentieth(df).collect())
    want = brute(rows)
    if scale == 1.0:
        assert got == want
    else:
        assert [(q, n, clamp(s)) for q, n, _, s in want] == [(q, n, s) for q, n, _, s in got]


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (None, [5.0, 5.0]), (0, [1.0, 2.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in topk.every_twentieth(df).collect()] == [(0, 1, 1, 64 * 64 + 128 * 64)]
    assert topk.every_twentieth(df.limit(0)).count() == 0


def test_large_components_cost_their_own_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 512)
    monkeypatch.setattr(topk, "GROUP", 1 << 14)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=8).tolist()) for i in range(3000)]
    rows[40] = (40, [1e12, *rows[40][1][1:]])
    rows[41] = (41, [-1e12, *rows[41][1][1:]])
    rows[60] = (60, [3e38] * 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    clamp = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    got = defaultdict(list)
    for x in sorted(topk.every_twentieth(df).collect(), key=lambda x: (x.query_id, x.rank)):
        got[x.query_id].append((x.vec_id, x.score))
    assert len(got) == 150
    for q, found in got.items():
        want = sorted((-clamp(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:20]
        assert found == [(i, -s) for s, i in want]


def plain_tree(rows, dims, node, leaves, out, used):
    """Shards of rows (id, size, keys) by a k-d tree in memory."""
    if leaves == 1 or not rows:
        out.update({i: node for i, _, _ in rows})
        return
    places = [[keys[d] >> 28 for _, _, keys in rows] for d in range(dims)]
    dim = max(range(dims), key=lambda d: (max(places[d]) - min(places[d]), -d))
    used.add(dim)
    want, seen, cut = sum(s for _, s, _ in rows) * (leaves // 2) / leaves, 0, None
    by_key = defaultdict(int)
    for _, s, keys in rows:
        by_key[keys[dim]] += s
    for k in sorted(by_key):
        if seen + by_key[k] >= want:
            cut = k - 1 if 2 * (want - seen) < by_key[k] else k
            break
        seen += by_key[k]
    plain_tree([x for x in rows if x[2][dim] <= cut], dims, node, leaves // 2, out, used)
    plain_tree([x for x in rows if x[2][dim] > cut], dims, node + leaves // 2, leaves - leaves // 2, out, used)


def test_tree_matches_a_plain_one(spark):
    r = random.Random(4)
    rows = [(i, "w" * r.randint(0, 60), r.choice(["en", "fr", None]), f"s{min(r.randint(0, 30), 9)}", r.choice([None, r.randint(1, 10), r.randint(1, 100_000)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    total = sum(len(x[1]) + 1 for x in rows)
    got = kdtree.placed(df, ("lang", "source", "n_chars"), target_bytes=-(-total // 37)).collect()
    want, used = {}, set()
    plain_tree([(x.id, x.size, (x.key0, x.key1, x.key2)) for x in got], 3, 0, 37, want, used)
    assert {x.id: x.node for x in got} == want and used == {0, 1, 2}
    assert all(0 <= k < 1 << 52 for x in got for k in (x.key0, x.key1, x.key2))
    at = defaultdict(int)
    for x in got:
        at[x.node] += x.size
    assert len(at) == 37 and max(at.values()) <= 2.5 * total / 37


def test_shards_of_several_types(spark):
    rows = [(i, "t", float("nan") if i % 5 == 0 else i / 7, i % 3 == 0) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, text string, weight double, flag boolean")
    got = kdtree.shards(df, n_shards=4, dims=("weight", "flag")).collect()
    assert Counter(x.shard for x in got) == {k: 16 for k in range(4)}


def test_draws_lie_in_the_order_of_the_mixture(spark):
    df = documents(spark)
    mix = mixing.Mix(df, block_tokens=256)
    place = defaultdict(list)
    for x in mix.drawn(mix.rows).collect():
        place[x.id].append(x.position)
    got = [x.doc_id for x in mixing.mixed(df, block_tokens=256).toLocalIterator()]
    assert Counter(got) == {i: len(p) for i, p in place.items()}
    left, last = {i: sorted(p) for i, p in place.items()}, -1.0
    for i in got:
        assert left[i][0] >= last
        last = left[i].pop(0)
    assert any(max(p) - min(p) > 0.1 for p in place.values() if len(p) > 1)
