"""Removal of repeated passages by seed and extend.

Seeds: every run of ``length`` words has a winnowed anchor, the leftmost smallest hash of its short word runs,
which depends on the run's words alone; equal runs have the same anchor at the same place. Documents are
joined on the anchors that occur more than once. Extension: from each such anchor the text is
followed both ways as far as a window of ``length`` words that has this anchor can reach, and the windows' 128-bit hashes are matched. All
but the earliest window of equal ones is repeated, and windows that overlap or touch fuse into maximal repeats.

Occurrences of an anchor are never paired with each other: each is held against the earliest one of the
same window, found by an aggregate that combines before it shuffles. So a passage in a third of all documents costs
no more than others of that size, and no occurrence is left out.

Order: the smaller id first, then the smaller start. Defined cases: null text has no words; rows with a null
id are returned unchanged and repeat nothing; rows that share an id count as one document: of a
window that several of them have, those with the smallest start keep it, all of them if they have one start; texts of fewer than ``length`` words stay whole; empty tables stay empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threadmill.llm.common import WORD_PATTERN, byte_slices, discard, free_names, materialise, small

#: Words of an anchor. Shorter ones are fewer, but in a large corpus more of them recur by chance alone.
SEED = 8
#: Anchors that have a thousandth of all repeated occurrences, of which there are a thousand at most, are dealt to so many tasks each.
HOT, SALTS = 1000, 64
#: Ids of several rows up to which they are broadcast.
_MOST_SHARED = 50_000
_draw = np.random.default_rng(20)
_COEFFICIENTS = _draw.integers(0, 1 << 63, (3, 4096), np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(WORD_PATTERN.encode())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _runs(h: np.ndarray, n: int, which: int) -> np.ndarray:
    """A hash of every run of n words; with several, of independent coefficients."""
    total = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        total += h[j : j + len(total)] * _COEFFICIENTS[which, j]
    return _mixed(total)


class _Doc:
    """The words of a text, and of each window of ``length`` words the place of its anchor."""

    def __init__(self, text: str | None, length: int, hashed: bool = True) -> None:
        self.text = (text or "").encode("utf-8")
        self.words, self.length = self.text.split(), length
        self.h = self.at = None
        if hashed and len(self.words) >= length:
            digest = xxhash.xxh64_intdigest
            self.h = np.array([digest(w) for w in self.words], np.uint64)
            self.grams = _runs(self.h, min(SEED, length), 0)
            inside = np.lib.stride_tricks.sliding_window_view(self.grams, length - min(SEED, length) + 1)
            self.at = np.arange(len(inside)) + inside.argmin(1)

    def anchors(self) -> np.ndarray:
        if self.at is None:
            return np.zeros(0, np.int64)
        return self.at[np.flatnonzero(np.diff(self.at, prepend=-1))]

    def candidates(self, seeds: np.ndarray | None) -> np.ndarray:
        """Starts of the windows whose anchors are among the seeds."""
        if self.at is None or seeds is None:
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.grams), bool)
        hit[seeds[seeds < len(hit)]] = True
        return np.flatnonzero(hit[self.at])

    def windows(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit hashes and starts of candidate windows, each window's first start in this text only."""
        start = self.candidates(seeds)
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), start
        a, b = _runs(self.h, self.length, 1)[start], _runs(self.h, self.length, 2)[start]
        order = np.lexsort((start, b, a))
        a, b, start = a[order], b[order], start[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[first], b[first], start[first]

    def covered(self, seeds: np.ndarray | None, firsts: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        """Of each word, whether it is removed. firsts: starts of windows that occur nowhere earlier, and where several rows have this id the windows' hashes, by which a row knows its own."""
        starts = self.candidates(seeds)
        if firsts is not None and len(starts):
            at, known = firsts
            if len(known):
                at, known = at[inside := at < len(self.at)], known[inside]
                at = at[_runs(self.h, self.length, 1)[at] == known.view(np.uint64)]
            earliest = np.zeros(len(self.at), bool)
            earliest[at] = True
            starts = starts[~earliest[starts]]
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.length, -1)
        return np.cumsum(edge)[:-1] > 0


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    for x in column:
        yield None if not x.is_valid else x.values.to_numpy()


def _pairs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    for x in column:
        yield None if not x.is_valid else (x["start"].values.to_numpy(), x["a"].values.to_numpy())


def _repeats(docs: DataFrame, id_col: str, text_col: str, length: int, finish: Callable, schema: T.StructType) -> DataFrame:
    """Rows of ``schema``: columns of docs, and what finish(document, mask of its removed words) returns by name. The ids of docs are not null."""
    kind = docs.schema[id_col].dataType.simpleString()
    seeds_id, seeds_at, firsts_id, firsts_at = free_names(docs, "seeds_id", "seeds_at", "firsts_id", "firsts_at")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                found = [(d.grams[p].view(np.int64), p) if len(p := (d := _Doc(x, length)).anchors()) else (np.zeros(0, np.int64), p) for x in part.column(1).to_pylist()]
                owner = np.repeat(np.arange(part.num_rows), [len(p) for _, p in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), part.column(0).take(pa.array(owner)), pa.array(np.concatenate([p for _, p in found]).astype(np.int32))], ["anchor", "id", "at"])

    seen = docs.select(id_col, text_col).mapInArrow(anchors, f"anchor bigint, id {kind}, at int")
    again = materialise(seen.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "again")
    total = again.agg(F.sum("n").alias("n")).first().n or 0
    hot = again.where(F.col("n") * HOT >= total).select("anchor", F.lit(True).alias("hot"))
    salt = F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")
    salted = seen.join(F.broadcast(hot), "anchor", "left").select("anchor", "id", "at", F.when(F.col("hot"), salt).otherwise(0).alias("salt"))
    every = F.when(F.col("n") * HOT >= total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    seeds = materialise(salted.join(again.select("anchor", F.explode(every).alias("salt")), ["anchor", "salt"]).groupBy(F.col("id").alias(seeds_id)).agg(F.collect_list("at").alias(seeds_at)), "seeds")
    discard(again)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, batch.schema.get_field_index(text_col)):
                found = [_Doc(x, length).windows(s) for x, s in zip(part.column(text_col).to_pylist(), _lists(part.column(seeds_at)))]
                owner = np.repeat(np.arange(part.num_rows), [len(s) for _, _, s in found])
                a, b, s = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(seeds_id).take(pa.array(owner)), pa.array(s.astype(np.int32))], ["a", "b", "id", "start"])

    hinted = docs.join(seeds, F.col(id_col) == F.col(seeds_id), "left")
    window = hinted.where(F.col(seeds_at).isNotNull()).mapInArrow(windows, f"a bigint, b bigint, id {kind}, start int")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):  # id and start in one number, whose least an aggregate can keep in place
        place = F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("start")
        least = window.groupBy("a", "b").agg(F.min(place.cast("decimal(32,0)")).alias("least"))
        earliest = least.withColumn("id", F.floor(F.col("least") / F.lit(1 << 31).cast("decimal(11,0)")).cast(kind)).withColumn("start", F.pmod("least", F.lit(1 << 31).cast("decimal(11,0)")).cast("int"))
    else:
        earliest = window.groupBy("a", "b").agg(F.min(F.struct("id", "start")).alias("least")).select("a", "least.id", "least.start")
    shared = small(docs.groupBy(F.col(id_col).alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared"), _MOST_SHARED)
    earliest = earliest.join(shared, F.col("id") == F.col("shared"), "left")
    lists = F.struct(F.collect_list("start").alias("start"), F.collect_list(F.when(F.col("shared").isNotNull(), F.col("a"))).alias("a"))
    firsts = materialise(earliest.groupBy(F.col("id").alias(firsts_id)).agg(lists.alias(firsts_at)), "firsts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, whole.schema.get_field_index(text_col))):
            done = []
            for x, s, f in zip(batch.column(text_col).to_pylist(), _lists(batch.column(seeds_at)), _pairs(batch.column(firsts_at))):
                d = _Doc(x, length, hashed=s is not None)
                done.append(finish(d, d.covered(s, f)))
            made = done[0].keys() if done else ()
            yield pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in done], to_arrow_type(f.dataType)) if f.name in made else batch.column(f.name) for f in schema.fields], schema.names)

    return hinted.join(firsts, F.col(seeds_id) == F.col(firsts_id), "left").mapInArrow(cut, schema)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """The id, ``n_words``, ``n_removed``, ``spans`` (maximal repeats as word positions, ends excluded) and ``kept`` (the words left, joined by a space)."""
    docs = df.select(F.col(id_col), F.col(text_col))
    schema = T.StructType([df.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.StringType())])

    def finish(d: _Doc, gone: np.ndarray) -> dict:
        if not gone.any():
            return {"n_words": len(gone), "n_removed": 0, "spans": [], "kept": b" ".join(d.words).decode()}
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        return {"n_words": len(gone), "n_removed": int(gone.sum()), "spans": edge.reshape(-1, 2).tolist(), "kept": b" ".join(w for w, g in zip(d.words, gone.tolist()) if not g).decode()}

    done = _repeats(docs.where(F.col(id_col).isNotNull()), id_col, text_col, length, finish, schema)
    rest = docs.where(F.col(id_col).isNull())
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    return done.unionByName(rest.select(id_col, F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<array<int>>").alias("spans"), F.array_join(words, " ").alias("kept")))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """All columns, with repeats cut out of the text; what is between two cuts keeps its white space. Texts without repeats, null ones too, stay as they are; a text of repeats alone becomes empty."""

    def finish(d: _Doc, gone: np.ndarray) -> dict:
        if not gone.any():
            return {text_col: d.text.decode()}
        place = [m.span() for m in _WORD.finditer(d.text)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (~gone).view(np.int8), [0])))).reshape(-1, 2).tolist()
        return {text_col: b" ".join(d.text[place[a][0] : place[b - 1][1]] for a, b in edge).decode()}

    usable = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    return _repeats(df.where(usable), id_col, text_col, length, finish, df.schema).unionByName(df.where(~F.coalesce(usable, F.lit(False))))


def digests(df: DataFrame) -> DataFrame:
    return repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
