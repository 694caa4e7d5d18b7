"""Stems of known words, and searches that read their own buckets."""

import re

from pyspark.sql import functions as F

from threadmill.functions import stems
from threadmill.functions.stems import stem
from threadmill.operators import search

#: Words and stems as the stemmer's authors publish them.
KNOWN = """
che che, checa chec, checar chec, checoslovaquia checoslovaqui, chefs chefs, chemise chemis, cheque chequ, chequeo cheque, cheques chequ, chester chest, chetumaleños chetumaleñ, cheyene cheyen, chía chi, chiapaneca chiapanec,
chiapas chiap, chicago chicag, chicana chican, chicas chic, chicharrones chicharron, chichimecas chichimec, chicles chicl, chico chic, torá tor, tórax torax, torcer torc, toreado tor, toreándolo tor, torear tor, toreara tor, torearlo tor,
toreó tore, torero torer, toreros torer, torio tori, tormentas torment, tornados torn, tornar torn, tornen torn, torneo torne, tornillos tornill, torniquete torniquet, toronto toront, toros tor, torpedearon torped, torpeza torpez,
torralba torralb, torre torr, torrenciales torrencial, torrente torrent, torreón torreon, torres torr
"""


def test_known_stems(spark):
    pairs = [tuple(x.split()) for x in KNOWN.split(",")]
    got = {r.w: r.s for r in spark.createDataFrame(pairs, "w string, t string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w, _ in pairs} == dict(pairs)


def test_rules(spark):
    """One word for each rule, worked out by hand."""
    pairs = [("rápidamente", "rapid"), ("soluciones", "solucion"), ("huyendo", "huyend"), ("paguen", "pag"), ("Niños", "niñ"), ("dándoselo", "dand"), ("", ""), (None, None)]
    got = [r.s for r in spark.createDataFrame(pairs, "w string, t string").coalesce(1).select(stem(F.col("w")).alias("s")).collect()]
    assert got[:-3] == [t for _, t in pairs[:-3]] and got[-2:] == ["", None]


def test_search_reads_its_buckets(spark, tmp_path):
    rows = [(1, "Los niños cantaban canciones"), (2, "Un niño canta"), (3, "La canción; canción del mar"), (4, None), (5, ""), (6, "mares")]
    df = spark.createDataFrame(rows, "seq long, text string")
    path = f"{tmp_path}/i"
    search.build(df, path, buckets=16)
    find = lambda *q, **o: {r.seq: r.score for r in search.search(spark, path, list(q), **o).collect()}
    assert find("niña") == {1: 1, 2: 1} and find("cantar", "NIÑOS") == {1: 2, 2: 2} and find("canciones") == {1: 1, 3: 2} and find("mar", "niño", every=False) == {1: 1, 2: 1, 3: 1, 6: 1} and find("nada") == {}
    plan = search.hits(spark, path, ["niña"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters" in plan
    assert len({r.f.rsplit("/", 2)[-2] for r in search.hits(spark, path, ["niña"]).select(F.input_file_name().alias("f")).collect()}) == 1
    search.build(df.limit(0), f"{tmp_path}/none")


def test_an_index_shuffles_words_once_and_stems_once(spark):
    """Beside the table of distinct words; nothing is sorted for a join, and no word is counted before its stem is known."""
    df = spark.createDataFrame([(1, "niños niño niño"), (1, "niña"), (2, None)], "seq long, text string")
    dealt = search._dealt(df, 16, "seq", "text", 8)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "SortMergeJoin" not in plan
    assert [(r.stem, r.seq, r.n) for r in dealt.collect()] == [("niñ", 1, 4)] == [(r.stem, r.seq, r.n) for r in search.index(df).collect()]


def test_branched_patterns_find_what_lists_of_suffixes_find():
    lists = [stems.PRONOUNS, [*stems.ACCENTED, *stems.PLAIN, "yendo"], stems.STANDARD, stems.Y_VERBS, [*stems.SOFT_VERBS, *stems.VERBS], [*stems.RESIDUAL, *stems.RESIDUAL_E], ["iv"], ["a", "ab", "abc"]]
    every = [f"{head}{s}{tail}" for x in lists for s in x for head in ("", "x", "canta") for tail in ("", "x", "s")]
    for x in lists:
        a, b = re.compile(stems.either(x)), re.compile(stems.branched(x))
        assert all((m and m.group()) == (n and n.group()) for w in every for m, n in [(a.search(w), b.search(w))])
