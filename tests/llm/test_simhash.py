import random

import numpy as np
import xxhash

from threadmill.llm import graph, simhash


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(fps):
        for j, y in fps[:n]:
            if (x ^ y).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in fps}


def near(r, n):
    """Texts of long documents with a word or two changed, so that fingerprints lie close together."""
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for g in range(n):
        words = [r.choice(vocabulary) for _ in range(300)]
        for _ in range(r.choice([1, 1, 3, 12])):
            copy = list(words)
            copy[r.randrange(300)] = r.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def test_groups_match_brute_force(spark):
    r = random.Random(3)
    texts = near(r, 40) + ["A b C", "a B c", "", "  \n", "one two"]
    rows = [(i * 3 + 1, t, 0) for i, t in enumerate(texts)]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.component_ids(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()}
    fps = [(i, fingerprint(t)) for i, t, _ in rows]
    root = brute(fps)
    assert got == {i: (f"{x:016x}", root[i]) for i, x in fps}
    assert len({v for _, v in got.values()}) < len(rows)


def test_links_of_clustered_fingerprints(spark):
    """Dense clusters take the hub way, others the probes; both give the same components as brute force."""
    r = random.Random(8)
    fps = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(40):
            x = centre
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    values = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    root = brute([(v, v & (1 << 64) - 1) for v in values])
    smallest = {v: min(w for w in values if root[w] == root[v]) for v in values}
    for dense in (5.0, 1e9):
        tree = {x.node: x.root for x in graph.components(simhash.links(df, 2, dense)).collect()}
        hubs = {v: tree.get(v, v) for v in values}
        for v in values:
            assert (hubs[v] == hubs[smallest[v]])
        assert len({hubs[v] for v in values}) == len({*smallest.values()})


def test_thresholds_cover_the_radius():
    r = np.random.default_rng(1)
    fp = r.integers(-(1 << 63), (1 << 63) - 1, 200)
    plan = simhash.Plan(simhash.bit_groups(np.eye(65) * 100 + 50, 3), 2)
    plan.learn({k: np.ones(1 << len(run)) for k, run in enumerate(plan.flat_runs())})
    ts, cost = plan.thresholds(simhash._bits(fp))
    assert (ts.sum(0) + 3 == 3).all() and np.isfinite(cost).all()
    assert sorted(b for g in plan.groups for b in g) == list(range(64))


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(70)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 71)} | {1000 + i: 1000 for i in range(1, 60)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_edges(spark):
    rows = [(1, "a b c d", None), (2, "A b c d", "x"), (3, None, "x"), (4, "", "y"), (None, "a b c d", "z"), (1, "a b c d", None), (9, "q " * 20000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id or 0) for x in kept.collect()) == [0, 1, 3, 9]
    assert simhash.component_ids(df.limit(0)).count() == 0
    assert simhash.dedup(df.limit(0)).count() == 0
