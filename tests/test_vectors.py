"""Clusters and groups over all rows against plain sequential versions."""

import random

import numpy as np
import pytest

from threadmill.operators import vectors
from threadmill.operators.graph import components

DIM = 6


def rows(r, n):
    centres = [[r.gauss(0, 1) for _ in range(DIM)] for _ in range(7)]
    out = [(i, [x + r.gauss(0, 0.45) for x in r.choice(centres)], r.choice("ab")) for i in r.sample(range(-50, 3 * n), n)]
    return out + [(9001, None, "a"), (9002, [], "a"), (9003, [0.0] * DIM, "b"), (9004, [1.0, None] + [0.0] * (DIM - 2), "b"), (9005, [float("nan")] + [0.0] * (DIM - 1), "a")] + [(9100 + k, [1.0] + [0.0] * (DIM - 1), "a") for k in range(40)]


def cosines(data, within):
    good = [x for x in data if x[1] and all(y is not None and y == y for y in x[1]) and any(x[1])]
    m = np.array([x[1] for x in good])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T
    if within:
        g = np.array([x[2] for x in good])
        near[g[:, None] != g[None, :]] = -2
    return [x[0] for x in good], near


def plain_dbscan(data, eps, least, within):
    data = sorted(data)
    ids, near = cosines(data, within)
    near = near >= 1 - eps
    core = near.sum(1) >= least
    out = {x[0]: -1 for x in data}
    for i in range(len(ids)):
        if core[i] and out[ids[i]] == -1:
            stack = [i]
            out[ids[i]] = ids[i]
            while stack:
                for k in np.flatnonzero(near[stack.pop()]).tolist():
                    if out[ids[k]] == -1:
                        out[ids[k]] = ids[i]
                        if core[k]:
                            stack.append(k)
    return out


def plain_condense(data, threshold, within):
    data = sorted(data)
    ids, near = cosines(data, within)
    out, leaders = {x[0]: x[0] for x in data}, []
    for i in range(len(ids)):
        hit = [k for k in leaders if near[i, k] >= threshold]
        if hit:
            out[ids[i]] = ids[hit[0]]
        else:
            leaders.append(i)
    return out


@pytest.mark.parametrize(("within", "tiles"), [(None, {}), ("kind", {"block": 50, "slice_": 70})])
def test_clusters_and_groups(spark, within, tiles):
    data = rows(random.Random(11), 260)
    df = spark.createDataFrame([(*x, 1) for x in data], "vec_id long, embedding array<double>, kind string, cluster int").repartition(3)
    for eps, least in ((0.1, 4), (0.3, 3)):
        got = {x.vec_id: x.cluster for x in vectors.dbscan(df, eps, least, within, **tiles).collect()}
        assert got == plain_dbscan(data, eps, least, within)
    for threshold in (0.7, 0.95):
        led = vectors.condense(df, threshold, within, **tiles)
        assert {x.vec_id: x.leader for x in led.collect()} == plain_condense(data, threshold, within)
    report = vectors.condensed(df, led, "kind").collect()
    assert [x["count"] for x in report] == sorted((x["count"] for x in report), reverse=True) and sum(x["count"] for x in report) == len(data)


def test_search_has_no_nested_loop(spark):
    data = rows(random.Random(12), 200)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, kind string")
    found = vectors.similar(df, df.where("vec_id % 3 = 0"), 0.9, block=40, slice_=60)
    ids, near = cosines(data, None)
    want = {(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a % 3 == 0 and a != b and near[i, j] >= 0.9}
    assert {(x.a, x.b) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_edges(spark):
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert vectors.dbscan(none, 0.5, 3).count() == vectors.condense(none, 0.5).count() == vectors.similar(none, none, 0.5).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        vectors.condense(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), 0.5).count()


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 300)] + [(500, 900), (900, 700), (7, 7)] + [(1000, 1000 + k) for k in range(1, 200)]
    random.Random(1).shuffle(links)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: 0 for k in range(1, 301)} | {900: 500, 700: 500} | {1000 + k: 1000 for k in range(1, 200)}


def test_frequent_terms_are_those_of_a_plain_count(spark):
    """Only pairs of words that may be listed are counted; nothing else is lost, ties included."""
    import random
    from collections import Counter

    from threadmill.operators import similarity

    r = random.Random(4)
    rows = [[f"w{int(r.paretovariate(0.8)) % 40}" for _ in range(r.randint(0, 12))] for _ in range(120)]
    d = spark.createDataFrame([(w, [f"{x} {y}" for x, y in zip(w, w[1:])]) for w in rows], "w array<string>, ww array<string>")
    n = Counter(t for w in rows for t in [*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))])
    for features in (1, 5, 20, 30, 5000):
        assert similarity.frequent_terms(d, features) == sorted(n, key=lambda t: (-n[t], t))[:features]


def test_cluster_terms_are_means_of_a_cluster(spark):
    from pyspark.sql import functions as F

    from threadmill.operators import similarity

    d = spark.createDataFrame([(i, t) for i, t in enumerate(["uno dos tres cuatro", "uno dos tres", None, "red green blue", "green blue red", "blue green"])], "seq int, text string")
    c = similarity.kmeans(d, 2)
    sums = {}
    rows = c.select("cluster", "features").collect()
    size = {k: sum(r.cluster == k for r in rows) for k in {r.cluster for r in rows}}
    for r in rows:
        for i, x in zip(r.features.indices.tolist(), r.features.values.tolist()):
            sums[r.cluster, c.vocabulary[i]] = sums.get((r.cluster, c.vocabulary[i]), 0) + x
    got = {(r.cluster, r.term): r.weight for r in similarity.cluster_terms(c, top=50).collect()}
    assert len(rows) == 5 and got.keys() == {k for k, x in sums.items() if x > 0}
    assert all(abs(got[k] - sums[k] / size[k[0]]) < 1e-9 for k in got)


def test_connected_parts_read_each_row_once():
    """Parts of random matrices and of a path, where a pass over the whole matrix for every step would read it 400 times."""
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            Counted.read += out.size
            return out

    r = np.random.default_rng(4)
    path = np.eye(400, dtype=bool) | np.eye(400, k=1, dtype=bool)
    for near, root in [(path, np.arange(400)), *((r.random((60, 50)) < share, r.integers(0, 40, 60)) for share in (0, 0.005, 0.02, 0.5, 1))]:
        Counted.read = 0
        got = {(frozenset(i.tolist()), frozenset(j.tolist())) for i, j in vectors._reached(near.view(Counted), root)}
        assert Counted.read <= 2 * near.size + 4 * sum(near.shape)  # the flags of rows are counted as well
        label = np.arange(sum(near.shape))
        links = [(i, len(root) + j) for i, j in zip(*np.nonzero(near))] + [(i, k) for i in np.flatnonzero(near.any(1)) for k in np.flatnonzero(near.any(1)) if root[i] == root[k]]
        for _ in range(len(label)):
            before = label.copy()
            for u, v in links:
                label[u] = label[v] = min(label[u], label[v])
            if (label == before).all():
                break
        want = {(frozenset(i for i in np.flatnonzero(label == x).tolist() if i < len(root)), frozenset(i - len(root) for i in np.flatnonzero(label == x).tolist() if i >= len(root))) for x in {label[u] for u, _ in links}}
        assert got == want
