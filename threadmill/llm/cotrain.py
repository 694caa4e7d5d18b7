"""A quality classifier by co-training on two views of a document.

One view is the content of the text: figures on its characters, words and lines, and frequencies of its character
shapes. The other is the page's metadata: source, language and length. Each view has a logistic regression. In every round both
score all documents, and the documents without a label about which one view is surest - within a share of all of them from
either end, and with a calibrated probability of ``sure`` at least - become pseudo-labels for the other view. At the end each view is calibrated on labels that it did not see, and
the calibrated log odds add up to one score for every document.

Classifiers are fitted on all labelled and all pseudo-labelled rows: each Newton step is one pass in which every task adds up the gradient and
the curvature of its rows, and sixteen tasks add up those sums, so that a fixed number of bytes reaches the driver, however many rows or partitions
there are. Calibration takes counts of the log odds, rounded to hundredths, of the labels that are held out (a quarter, by a hash of the id). Defined cases: null
text counts as empty and null metadata as values of their own; labels without documents and null labels teach nothing, of repeated labels
of an id the highest counts; with labels of one class or none every score is that class's share (0.5 for none); repeated rows
are each scored and each teach; null ids have no label; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import byte_slices, materialise

SHAPES, FIGURES, META = 256, 12, 96
#: Newton steps of the first fit, from nothing, and of each round, from the weights before it.
STEPS, ROUND_STEPS = 8, 2
_SYMBOLS = b"#*$%&|<>"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The shape class (below 32) of each byte, and the bucket of each row of three classes."""
    c = np.full(256, 30, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            c[b] = 1
        elif 65 <= b <= 90:
            c[b] = 2
        elif 48 <= b <= 57:
            c[b] = 3
        elif b in b" \t\r\x0b\x0c":
            c[b] = 4
        elif b == 10:
            c[b] = 5
        elif b < 128:
            c[b] = 6 + b % 24
        elif b < 192:
            c[b] = 31
    return c, np.array([zlib.crc32(k.to_bytes(2, "little")) % SHAPES for k in range(1 << 15)])


def content(text: str | None) -> np.ndarray:
    """The content view of a text."""
    raw = (text or "").encode("utf-8")
    out = np.zeros(SHAPES + FIGURES, np.float32)
    classes, bucket = _tables()
    s = classes[np.frombuffer(raw, np.uint8)]
    if len(s) > 2:
        out[:SHAPES] = np.log1p(np.bincount(bucket[s[:-2] << 10 | s[1:-1] << 5 | s[2:]], minlength=SHAPES) * (1000 / len(s)))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, share = max(len(words), 1), np.bincount(s, minlength=32) / max(len(s), 1)
    pairs = {*zip(words, words[1:])}
    out[SHAPES:] = [np.log1p(len(words)), len(raw) / n / 10, len({*words}) / n, len(pairs) / n, len({*lines}) / max(len(lines), 1), len(lines) / n * 10, share[2] * 5, share[3] * 5, (len(raw) - len(raw.translate(None, _SYMBOLS))) / max(len(raw), 1) * 10, share[6:30].sum() * 5, raw.count(b".") / n, share[30:].sum()]
    return np.minimum(out, 1000.0)


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: one of 64 buckets of sources, 16 of languages and 16 of lengths each."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(source).encode()) % 64] = 1
    out[64 + zlib.crc32(repr(lang).encode()) % 16] = 1
    out[80 + (0 if n_chars is None else min(15, max(0, int(n_chars)).bit_length() // 2 + 1))] = 1
    return out


def features(df: DataFrame) -> DataFrame:
    """doc_id and both views as half-precision binary: the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, 1):
                key, text, source, lang, size = piece.columns
                a = [content(x).astype(np.float16).tobytes() for x in text.to_pylist()]
                b = [metadata(*x).astype(np.float16).tobytes() for x in zip(source.to_pylist(), lang.to_pylist(), size.to_pylist())]
                yield pa.RecordBatch.from_arrays([key, pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "content", "metadata"])

    return df.select("doc_id", "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, content binary, metadata binary")


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(len(column), -1).astype(np.float64)


def _step(w: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """A Newton step of a logistic regression with a quadratic penalty, no longer than 5 in any weight."""
    step = np.linalg.solve(curvature + l2 * np.eye(len(w)), gradient - l2 * w)
    return step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log likelihood; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton steps over rows in memory."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(STEPS):
        w = w + _step(w, *_slopes(x, y, w, weight))
    return w


def calibrate(odds: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and intercept of the log odds, by a regression on rows that the classifier didn't see."""
    if len({*y.tolist()}) < 2:
        return 1.0, 0.0
    a, b = fit(odds[:, None], y, weight)
    return max(float(a), 0.0), float(b)


class Teachers:
    """Both views as they were when a round began, and the log odds below and above which each is sure."""

    def __init__(self, models: list[tuple[np.ndarray, float, float]], ends: list[tuple[float, float]]) -> None:
        self.models, self.ends = models, ends

    def guesses(self, view: int, x: np.ndarray) -> np.ndarray:
        """1, 0 or NaN (not sure) for each row of the view's features."""
        w, a, b = self.models[view]
        odds, (low, high) = a * (x @ w[:-1] + w[-1]) + b, self.ends[view]
        return np.where(odds >= high, 1.0, np.where(odds <= low, 0.0, np.nan))


def _total(rows: DataFrame, now: list[np.ndarray], teachers: Teachers | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of each view over all rows that teach it: labelled ones that are not held out, and those without a label of which the other view is sure."""
    sizes = [len(w) for w in now]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n * (n + 1)) for n in sizes]
        for piece in (p for batch in batches for p in byte_slices(batch, 2)):
            y = np.array(piece.column(0).to_pylist(), float)
            labelled, held = ~np.isnan(y), np.array(piece.column(1).to_pylist(), bool)
            views = [_matrix(piece.column(2 + k).to_pylist()) for k in (0, 1)]
            for k, x in enumerate(views):
                taught = y.copy()
                if teachers is not None:
                    taught[~labelled] = teachers.guesses(1 - k, views[1 - k][~labelled])
                used = ~np.isnan(taught) & ~(labelled & held)
                if used.any():
                    total[k] += np.concatenate([part.ravel() for part in _slopes(x[used], taught[used], now[k])])
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(total).tobytes()], pa.binary())], ["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(n * (n + 1) for n in sizes))
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.select(F.col("y").cast("double"), "held", "content", "metadata").mapInArrow(add, "sums binary")
    got = sum((np.frombuffer(r.sums) for r in parts.repartition(16).mapInArrow(merge, "sums binary").collect()), np.zeros(sum(n * (n + 1) for n in sizes)))
    out, at = [], 0
    for n in sizes:
        out.append((got[at : at + n], got[at + n : at + n * (n + 1)].reshape(n, n)))
        at += n * (n + 1)
    return out


def _trained(rows: DataFrame, start: list[np.ndarray], teachers: Teachers | None, steps: int) -> list[np.ndarray]:
    """The weights of both views after so many Newton steps over all rows, or when they hardly move any more."""
    now = start
    for _ in range(steps):
        moved = [_step(w, *slopes) for w, slopes in zip(now, _total(rows, now, teachers))]
        now = [w + m for w, m in zip(now, moved)]
        if max(np.abs(m).max() for m in moved) < 1e-3:
            break
    return now


def _calibrated(held: DataFrame, weights: list[np.ndarray]) -> list[tuple[np.ndarray, float, float]]:
    """Each view's weights, slope and intercept, from counts of the rounded log odds of held-out labels."""
    found = _odds(held, [(w, 1.0, 0.0) for w in weights]).select("y", F.posexplode(F.array("odds_content", "odds_metadata")).alias("view", "odds"))
    rounded = F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("odds"))), 2).alias("odds")
    counts = found.groupBy("view", "y", rounded).count().toPandas()
    models = []
    for k, w in enumerate(weights):
        of = counts[counts["view"] == k]
        models.append((w, *calibrate(of["odds"].to_numpy(float), of["y"].to_numpy(float), of["count"].to_numpy(float))))
    return models


def _odds(rows: DataFrame, models: list[tuple[np.ndarray, float, float]]) -> DataFrame:
    """doc_id, y and the calibrated log odds of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (w, a, b) in enumerate(models):
                m = _matrix(batch.column(2 + k).to_pylist()) if batch.num_rows else np.zeros((0, len(w) - 1))
                out.append(pa.array(a * (m @ w[:-1] + w[-1]) + b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], ["doc_id", "y", "odds_content", "odds_metadata"])

    return rows.select("doc_id", "y", "content", "metadata").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, odds_content double, odds_metadata double")


def scores(df: DataFrame, labels: DataFrame, label_col: str = "quality", rounds: int = 3, share: float = 0.05, sure: float = 0.9, threshold: float = 0.2) -> DataFrame:
    """doc_id, ``p_content`` and ``p_metadata`` (the calibrated views), ``score`` and ``kept`` (score at least the threshold) of every document."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    named, nameless = features(df.where("doc_id is not null")).join(known, "doc_id", "left"), features(df.where("doc_id is null")).withColumn("y", F.lit(None).cast("int"))
    held = F.col("y").isNotNull() & (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)) == 3)
    rows = materialise(named.unionByName(nameless).withColumn("held", held), "features")
    taught = materialise(rows.where("y is not null"), "labelled")
    seen = taught.agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high")).first()
    mean = 0.5 if seen.mean is None else float(seen.mean)
    if seen.mean is None or seen.low == seen.high:
        flat = [F.lit(mean).alias(c) for c in ("p_content", "p_metadata", "score")]
        return rows.select("doc_id", *flat, F.lit(mean >= threshold).alias("kept"))
    weights = _trained(taught.where("not held"), [np.zeros(SHAPES + FIGURES + 1), np.zeros(META + 1)], None, STEPS)
    models = _calibrated(taught.where("held"), weights)
    least = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        pool = _odds(rows.where("y is null"), models)
        ends = pool.agg(*[F.percentile_approx(c, [share, 1 - share], 10_000).alias(c) for c in ("odds_content", "odds_metadata")]).first()
        if ends[0] is None:
            break
        weights = _trained(rows, weights, Teachers(models, [(min(e[0], -least), max(e[1], least)) for e in ends]), ROUND_STEPS)
        models = _calibrated(taught.where("held"), weights)
    base = float(np.log(mean / (1 - mean)))
    total = F.col("odds_content") + F.col("odds_metadata") - F.lit(base)
    p = lambda c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))))
    done = _odds(rows, models)
    return done.select("doc_id", p(F.col("odds_content")).alias("p_content"), p(F.col("odds_metadata")).alias("p_metadata"), p(total).alias("score")).withColumn("kept", F.col("score") >= threshold)
