import math
import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from threadmill.llm import ppm


def sequence(text):
    return b" ".join((text or "").lower().encode().split()) if (text or "").isascii() else b" ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split())


class Book:
    """PPM by the textbook: method C, exclusion of the symbols that longer contexts have seen."""

    def __init__(self, order):
        self.order, self.seen = order, defaultdict(Counter)

    def learn(self, s):
        for i in range(self.order, len(s)):
            for k in range(self.order + 1):
                self.seen[s[i - k : i]][s[i]] += 1

    def p(self, context, symbol):
        esc, excluded = 1.0, set()
        for k in range(self.order, -1, -1):
            after = self.seen.get(context[self.order - k :] if k else b"")
            if not after:
                continue
            left = {x: c for x, c in after.items() if x not in excluded}
            if symbol in left:
                return esc * left[symbol] / (sum(left.values()) + len(left))
            if left:
                esc *= len(left) / (sum(left.values()) + len(left))
            excluded |= set(after)
        return esc / (256 - len(excluded))


def brute(rows, order=ppm.ORDER):
    out_of = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    book, words = Book(order), Counter()
    for i, text in rows:
        if not out_of(i):
            book.learn(b"\xff" * order + sequence(text) + b"\xff")
            words.update([*sequence(text).split(), None])
    n, v = sum(words.values()), len(words)
    found = []
    for i, text in rows:
        s, tokens = b"\xff" * order + sequence(text) + b"\xff", [*sequence(text).split(), None]
        score = sum(math.log10(book.p(s[k - order : k], s[k])) for k in range(order, len(s)))
        found.append((i, out_of(i), len(tokens), sum(t in words for t in tokens), n, sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), score))
    return found


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, 3, "w") for i, t in rows], "doc_id long, text string, block int, word string").repartition(parts)
    got = sorted((tuple(x) for x in ppm.tenth_held_out(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9), (g, w)


def corpus(r, n):
    vocabulary = ["".join(r.choice("abcdEé") for _ in range(r.randint(1, 5))) for _ in range(40)]
    return [(i, "".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.randint(0, 30)))) for i in range(n)]


def test_scores_match_the_textbook(spark):
    r = random.Random(2)
    rows = corpus(r, 150) + [(900, None), (901, ""), (None, "only here: 漢字"), (902, "zq " * 5), (903, " \n ")]
    check(spark, rows + rows[:5] * 4, 3)


def test_pieces_and_blocks_do_not_matter(spark, monkeypatch):
    r = random.Random(3)
    rows = corpus(r, 60) + [(700, "Some long text. " * 300), (701, "x" * 2000)]
    monkeypatch.setattr(ppm, "_PIECE", 100)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 500)
    assert b"".join(b for _, b, _ in ppm.segments(rows[-2][1], 100)) == sequence(rows[-2][1]) + b"\xff"
    check(spark, rows, 4)


def test_probabilities_add_up_to_one(spark):
    """Of all 256 symbols after any context, one that nothing follows included."""
    r = random.Random(4)
    seen = Counter(tuple(r.choice(b"ab") for _ in range(ppm.ORDER + 1)) for _ in range(60))
    pack = lambda run: sum(b << 8 * k for k, b in enumerate(reversed(run)))
    contexts = {g[:-1] for g in seen} | {tuple(b"zzzzz"), tuple(b"zzzza")}
    rows = [(pack((*c, s)), seen.get((*c, s), 0)) for c in contexts for s in range(256)]
    sums = ppm.trie(spark.createDataFrame(rows, "gram long, n long")).groupBy(F.shiftright("gram", 8)).agg(F.sum(F.pow(F.lit(10.0), "log_p")).alias("p")).collect()
    assert len(sums) == len(contexts) and all(abs(x.p - 1) < 1e-9 for x in sums)


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(spark, [(held, "one text")], 1)
    assert ppm.tenth_held_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_adaptive_code_length(spark):
    rows = [(1, "abracadabra abracadabra"), (2, None), (3, "aaaa " * 100), (4, "éé é")]
    got = {x.doc_id: x for x in ppm.adaptive(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        book, s, bits = Book(ppm.ORDER), b"\xff" * ppm.ORDER + sequence(text) + b"\xff", 0.0
        for k in range(ppm.ORDER, len(s)):
            bits -= math.log2(book.p(s[k - ppm.ORDER : k], s[k]))
            book.learn(s[k - ppm.ORDER : k + 1])
        assert got[i].n_symbols == len(s) - ppm.ORDER and math.isclose(got[i].bits, bits, rel_tol=1e-9)


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """By the size of their files even these tables would be; only contexts of one or two bytes may be."""
    plans, write = {}, ppm.materialise

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(ppm, "materialise", seen)
    df = spark.createDataFrame([(i, f"some words of text {i} and some more") for i in range(50)], "doc_id long, text string")
    done = ppm.tenth_held_out(df)
    assert done.count() == 50
    assert all(plans[name].count("BroadcastHashJoin") <= most for name, most in (("trie", 2), ("runs", 0), ("words", 0)))
    assert "SortMergeJoin" in plans["trie"] and "SortMergeJoin" in plans["runs"] and "SortMergeJoin" in plans["words"]
