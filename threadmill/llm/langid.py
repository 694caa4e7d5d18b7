"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that its code point alone determines. An n-gram's vector binds (multiplies)
the vectors of its letters, each permuted (rolled) by its place; a text's vector bundles (adds) those of its n-grams.
A language's prototype bundles the vectors of all its training texts. A document gets the language whose prototype has the largest cosine with it.

Texts are put in lower case, and everything between letters counts as one space. Defined cases: texts that are null or have no
letter, and all texts where nothing could be learned, are ``und`` with score 0; ties go to the first language in alphabetical
order; null languages teach nothing; a null id is hashed as an empty one; repeated rows are predicted and learned from each.
Memory: documents are taken in slices of bytes, their distinct n-grams in slices of ``GRAMS``, so that no matrix grows with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import byte_slices, checkpointed, materialise

#: Components of a vector, letters of an n-gram (at most 3, of 21 bits each), documents and bytes that are bundled together, and n-grams whose vectors stand in memory at once.
SIZE, LETTERS, DOCS, BYTES, GRAMS = 1024, 3, 256, 1 << 20, 4096
UNDETERMINED = "und"


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(32_768)
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, SIZE, np.int8) * 2 - 1).astype(np.int8)


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams, as packed code points, and their counts; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes = np.concatenate(([32], codes[kept], [32]))
    packed = codes[: -(LETTERS - 1)].copy()
    for k in range(1, LETTERS):
        packed = packed << 21 | codes[k : len(codes) - LETTERS + 1 + k]
    return np.unique(packed, return_counts=True)


def _vectors(packed: np.ndarray) -> np.ndarray:
    """The bound vector of each n-gram."""
    out = np.ones((len(packed), SIZE), np.int8)
    for k in range(LETTERS):
        codes, at = np.unique((packed >> (21 * k)) & 0x1FFFFF, return_inverse=True)
        out *= np.array([np.roll(_letter(int(c)), k) for c in codes])[at]
    return out


def _bundle(found: list[tuple[np.ndarray, np.ndarray]], owner: list[int], rows: int) -> np.ndarray:
    """The sum of the n-gram vectors of each owner; counts and sums stay whole numbers below 2 ** 24 or go by float64."""
    packed, counts = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
    owners = np.repeat(np.array(owner, np.int64), [len(p) for p, _ in found])
    order = np.argsort(packed, kind="stable")
    packed, counts, owners = packed[order], counts[order], owners[order]
    begins = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    kind = np.float64 if np.bincount(owners, counts).max() >= 1 << 24 else np.float32
    total = np.zeros((rows, SIZE))
    for at in range(0, len(begins), GRAMS):
        some = begins[at : at + GRAMS]
        end = begins[at + GRAMS] if at + GRAMS < len(begins) else len(packed)
        column = np.repeat(np.arange(len(some)), np.diff([*some, end]))
        each = np.bincount(owners[some[0] : end] * len(some) + column, counts[some[0] : end], rows * len(some))
        total += each.reshape(rows, len(some)).astype(kind) @ _vectors(packed[some]).astype(kind)
    return total


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of every language, from all rows. Per language SIZE numbers reach the driver: the result grows with the number of languages alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in byte_slices(batch, 0, BYTES, DOCS):
                got = [(lang, f) for text, lang in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()) if (f := _ngrams(text)) is not None]
                if not got:
                    continue
                langs = sorted({lang for lang, _ in got})
                for lang, v in zip(langs, _bundle([f for _, f in got], [langs.index(lang) for lang, _ in got], len(langs))):
                    total[lang] = total.get(lang, 0) + v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * SIZE), pa.array(np.arange(SIZE, dtype=np.int32)), pa.array(v.astype(np.int64))], ["lang", "i", "v"])

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(run, "lang string, i int, v bigint").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r.lang, np.zeros(SIZE))[r.i] = r.v
    return out


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, ``lang_pred`` and ``score``: the cosine, at least 0."""
    langs = sorted(prototypes)
    unit = np.array([prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-9) for x in langs]).reshape(len(langs), SIZE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, len(keep), BYTES, DOCS):
                found = [(i, f) for i, text in enumerate(piece.column(len(keep)).to_pylist()) if text and (f := _ngrams(text)) is not None]
                pred, score = [UNDETERMINED] * piece.num_rows, np.zeros(piece.num_rows)
                if found and langs:
                    v = _bundle([f for _, f in found], [*range(len(found))], len(found))
                    cosine = (v @ unit.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                    for (i, _), c in zip(found, cosine):
                        pred[i], score[i] = langs[c.argmax()], min(1.0, max(0.0, c.max()))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(pred), pa.array(score)], [*keep, "lang_pred", "score"])

    kept = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(text_col)).mapInArrow(run, ", ".join([*kept, "lang_pred string", "score double"]))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(df: DataFrame) -> DataFrame:
    """Predictions for all documents; those of fold 2 taught nothing."""
    prototypes = fit(df.where(fold(F.col("doc_id")) != 2))
    done = predict(df.select("doc_id", "text"), prototypes)
    return done.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def _length_class(text: Column) -> Column:
    """Texts of 2 ** k characters or more and below 2 ** (k + 1) are of class k; scores of short texts are lower and spread wider."""
    return F.floor(F.log2(F.length(text) + 1)).cast("int")


def bounds(predicted: DataFrame, spread: float = 12.0, least: float = 0.02) -> DataFrame:
    """``of``, ``size`` and ``low``: for each language and class of lengths the median score less ``spread`` times the lower quartile's distance from it, or ``least``. predicted: lang_pred, size, score."""
    q = predicted.where(F.col("lang_pred") != UNDETERMINED).groupBy(F.col("lang_pred").alias("of"), F.col("size").alias("of_size")).agg(F.percentile_approx("score", [0.25, 0.5], 10_000).alias("q"))
    return q.select("of", "of_size", F.expr(f"q[1] - {spread} * greatest(q[1] - q[0], {least}D)").alias("low"))


def accept(df: DataFrame, min_score: float | None = None, text_col: str = "text", lang_col: str = "lang", spread: float = 12.0) -> DataFrame:
    """All columns of the rows whose language is known: not ``und``, and a score of at least ``min_score`` or, without one, of the bound of its language and length (see ``bounds``). Learns from all rows that have a language; where none has, rows with a letter are kept."""
    prototypes = fit(df, text_col, lang_col)
    if not prototypes:
        return df.where(F.col(text_col).rlike(r"\p{L}"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _length_class(F.col(text_col)).alias("size"), F.col(text_col).alias("text"))
    done = predict(rows, prototypes, "text", ("row", "size"))
    if min_score is not None:
        return done.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
    done = materialise(done, "languages")
    low = checkpointed(bounds(done, spread))
    judged = done.join(F.broadcast(low), (F.col("lang_pred") == F.col("of")) & (F.col("size") == F.col("of_size")))
    return judged.where(F.col("score") >= F.col("low")).select("row.*")
