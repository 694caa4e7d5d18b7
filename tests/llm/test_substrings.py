import hashlib
import random

from threadmill.llm import substrings


def brute(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(r):
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice([19, 20, 21, 45, 80]))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.randint(0, 5)):
            words += r.choice(passages) if r.random() < 0.4 else [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        rows.append((i, " ".join(words)))
    rows += [(500, "same " * 200), (501, "same " * 19), (502, "a b " * 70), (503, None), (504, ""), (505, rows[3][1]), (506, rows[3][1])]
    return rows


def test_removed_words_match_brute_force(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_words int").repartition(5)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.digests(df).collect()}
    assert got == brute(rows)


def test_spans_and_text(spark):
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(10))
    df = spark.createDataFrame([(1, a, "k"), (2, f"{b}\n{a}\t{b} z", "k"), (3, a, None)], "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in substrings.repeats(df).collect()}
    assert [got[i].spans for i in (1, 2, 3)] == [[], [[10, 40]], [[0, 30]]]
    cut = {x.doc_id: x.text for x in substrings.dedup(df).collect()}
    assert cut == {1: a, 2: f"{b} {b} z", 3: ""}
    assert substrings.dedup(df).columns == df.columns


def test_edges(spark):
    t = " ".join(str(i) for i in range(40))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, None), (3, t + " more")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in substrings.digests(df).collect())
    assert got == [(0, 40, 0), (1, 40, 0), (1, 40, 0), (2, 0, 0), (3, 41, 40)]
    assert substrings.digests(df.limit(0)).count() == 0
    assert substrings.dedup(df).count() == 5


def brute_rows(rows, length=20):
    """A window is kept where no occurrence has a smaller id, or the same id and a smaller start."""
    first = {}
    for i, text in rows:
        w = text.split()
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for i, text in rows:
        w = text.split()
        gone = {s + k for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] != (i, s) for k in range(length)}
        out.append((i, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_rows_that_share_an_id(spark):
    """The result follows from the rows, not from how they are dealt."""
    p, q = (" ".join(f"{c}{k}" for k in range(20)) for c in "pq")
    r = random.Random(8)
    mixed = [(r.choice([3, 4, -5]), " ".join(r.choice([p, q, "x y", "z"]) for _ in range(r.randint(1, 4)))) for _ in range(25)]
    for rows in ([(1, p), (7, p), (7, q), (8, "a b c " + q)], [(7, "a b c d e " + p), (7, "z " + p), (8, p)], mixed):
        for parts in (1, 2, 3):
            for kind in ("long", "string"):
                df = spark.createDataFrame([(str(50 + i) if kind == "string" else i, t) for i, t in rows], f"doc_id {kind}, text string").repartition(parts)
                got = sorted((int(x.doc_id) - 50 if kind == "string" else x.doc_id, x.n_words, x.kept) for x in substrings.repeats(df).collect())
                assert got == brute_rows(rows)


def test_a_very_long_text(spark):
    long = " ".join(str(k) for k in range(300_000))
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.repeats(spark.createDataFrame([(1, "own words " + long), (2, long + " more")], "doc_id long, text string")).collect()}
    assert got == {1: (300_002, 0), 2: (300_001, 300_000)}
