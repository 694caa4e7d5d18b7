import random

import numpy as np
import pytest

from threadmill.llm import cotrain


def tables(spark, n=900, labelled=0.35, seed=3):
    """Good documents are sentences from good sites, bad ones symbols and shouting from others; some sites have both."""
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        words = ["".join(r.choice("theandofinrs") for _ in range(r.randint(2, 7))) for _ in range(r.randint(20, 60))]
        if not good:
            words = [w.upper() if r.random() < 0.5 else w + r.choice("#*$%") for w in words]
        site = r.choice(["s0", "s1", "s2"] if good else ["x0", "x1", "s2"])
        text = " ".join(words) + "."
        docs.append((i, text, r.choice(["en", "fr"]), site, len(text), "clash"))
        if r.random() < labelled:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, y string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain(rows, known, held, rounds=3, share=0.05, sure=0.9):
    """The same training over rows in memory."""
    views = [np.array([f(x).astype(np.float16).astype(float) for x in rows]) for f in (lambda x: cotrain.content(x.text), lambda x: cotrain.metadata(x.source, x.lang, x.n_chars))]
    y = np.array([known.get(x.doc_id, np.nan) for x in rows])
    labelled, held = ~np.isnan(y), np.array([x.doc_id in held for x in rows])

    def train(start, steps, guesses):
        out = []
        for k, w in enumerate(start):
            use, target = labelled & ~held, y.copy()
            if guesses is not None:
                target = np.where(labelled, y, guesses[1 - k])
                use = use | (~labelled & ~np.isnan(target))
            for _ in range(steps):
                w = w + cotrain._step(w, *cotrain._slopes(views[k][use], target[use], w))
            out.append(w)
        return out

    def calibrated(weights):
        models = []
        for v, w in zip(views, weights):
            odds = np.round(np.clip(v @ w[:-1] + w[-1], -30, 30), 2)[labelled & held]
            models.append((w, *cotrain.calibrate(odds, y[labelled & held])))
        return models

    odds = lambda models: [a * (v @ w[:-1] + w[-1]) + b for v, (w, a, b) in zip(views, models)]
    models = calibrated(weights := train([np.zeros(v.shape[1] + 1) for v in views], cotrain.STEPS, None))
    least = np.log(sure / (1 - sure))
    for _ in range(rounds):
        guesses = []
        for o in odds(models):
            ranked = np.sort(o[~labelled])
            low, high = (ranked[int(np.ceil(q * len(ranked))) - 1] for q in (share, 1 - share))
            guesses.append(np.where(o >= max(high, least), 1.0, np.where(o <= min(low, -least), 0.0, np.nan)))
        models = calibrated(weights := train(weights, cotrain.ROUND_STEPS, guesses))
    mean = y[labelled].mean()
    total = sum(odds(models)) - np.log(mean / (1 - mean))
    return {x.doc_id: p for x, p in zip(rows, 1 / (1 + np.exp(-np.clip(total, -30, 30))))}


def test_rounds_calibration_and_combination(spark):
    df, labels = tables(spark)
    known = {x.doc_id: x.quality for x in labels.collect()}
    held = {x.doc_id for x in df.selectExpr("doc_id", "pmod(xxhash64(cast(doc_id as string)), 4) = 3 as held").collect() if x.held and x.doc_id in known}
    rows = df.collect()
    want = plain(rows, known, held)
    got = {x.doc_id: x for x in cotrain.scores(df, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i].score - want[i]) for i in want) < 1e-3
    truth = {x.doc_id: not any(c in "#*$%" for c in x.text) for x in rows}
    unseen = [i for i in truth if i not in known]
    assert sum((got[i].score >= 0.5) == truth[i] for i in unseen) >= 0.97 * len(unseen)
    assert all(got[i].kept == (got[i].score >= 0.2) and 0 <= got[i].p_content <= 1 and 0 <= got[i].p_metadata <= 1 for i in got)


def test_partitions_change_nothing(spark):
    df, labels = tables(spark, 300)
    a, b = ({x.doc_id: x.score for x in cotrain.scores(d, labels).collect()} for d in (df.repartition(1), df.repartition(9)))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_edges(spark):
    df, labels = tables(spark, 200)
    odd = [(None, "no id here", "en", "s0", 10, None), (None, None, None, None, None, None), (1000, None, "en", "s1", None, "y"), (1001, "", None, None, 0, "y"), (1002, "word " * 60000, "en", "s0", 300000, "y"), (1003, "x" * 1_000_000, "en", "s0", 1_000_000, "y"), (1004, "same", "en", "s0", 4, "y"), (1004, "same", "en", "s0", 4, "y")]
    both = df.unionByName(spark.createDataFrame(odd, df.schema))
    more = labels.unionByName(spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (77777, 1, 0), (2, None, 0), (3, 7, 0)], labels.schema))
    got = cotrain.scores(both, more).collect()
    assert len(got) == 208 and all(np.isfinite(x.score) for x in got)
    assert len({x.score for x in got if x.doc_id == 1004}) == 1 and sum(x.doc_id is None for x in got) == 2
    assert cotrain.scores(df.limit(0), labels).count() == 0


@pytest.mark.parametrize(("where", "score"), [("quality = 1", 1.0), ("quality = 0", 0.0), ("false", 0.5)])
def test_one_class_or_none(spark, where, score):
    df, labels = tables(spark, 60)
    got = cotrain.scores(df, labels.where(where)).collect()
    assert len(got) == 60 and {(x.score, x.kept) for x in got} == {(score, score >= 0.2)}
