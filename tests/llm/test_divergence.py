import random
import re
from collections import Counter, defaultdict

from threadmill.llm import divergence


def brute(rows, least=30, top=50):
    """The audit by its definition, with Python's whole numbers."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: count[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            words = sorted(((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]))[:top]
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(words, 1)}
    return out


def corpus(r, n, sources, words):
    vocabulary = [r.choice(["Ab", "é", "漢", "zO", "Àé"]) + "".join(r.choice("abcdeXYZéß") for _ in range(r.randint(0, 3))) for _ in range(words)]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", "1", "\n", "_", "[", "`", "\x7f", "@"]) for _ in range(r.randint(0, 60)))
    return [(text(), r.choice(["en", "en", "de", "", None]), r.choice(sources)) for _ in range(n)]


def check(spark, rows, parts, **more):
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], "text string, lang string, source string, block int, term string").repartition(parts)
    got = [tuple(x) for x in divergence.audit(df, **more).collect()]
    want = brute(rows, more.get("least_docs", 30), more.get("top", 50))
    assert len(got) == len(want) and set(got) == want


def test_audit_matches_brute_force(spark):
    r = random.Random(3)
    check(spark, corpus(r, 900, ["a", "b", "", None, "ß", "c c"], 120), 5)


def test_many_blocks_and_chunks(spark, monkeypatch):
    """Tiles of several blocks, chunks and spans give what one tile gives."""
    r = random.Random(5)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "SPAN", 2)
    monkeypatch.setattr(divergence, "_FLUSH", 50)
    check(spark, corpus(r, 300, [f"s{k}" for k in range(14)], 150), 4, least_docs=2, top=5)


def test_without_terms_and_edges(spark):
    rows = [(None, "en", "a"), ("x", "en", "b"), ("1 2", "en", None), ("word", "fr", "only"), (None, None, None)]
    check(spark, rows, 2)
    check(spark, [("Same words here", "en", s) for s in ["a", "b", "b"] * 40] + [("same", "en", "c")] * 40, 3)
    check(spark, [("long Text " * 200_000, "en", "a"), ("text", "en", "b")], 2, least_docs=1)
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_terms_in_pieces():
    text = "Ab, cd_é-漢 " * 100
    assert [t for part in divergence.terms(text, 16) for t in part] == [t for part in divergence.terms(text) for t in part] == [t.encode() for t in ("ab", "cd", "é", "漢") * 100]
