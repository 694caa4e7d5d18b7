"""Near copies that SimHash's radius leaves: sets of word shingles with an exact similarity.

A fingerprint of 64 bits tells copies from near copies, but a similarity of 0.8 is some ten bits, where every region of the index is crowded. So after SimHash has left one of each group of (almost) equal texts, MinHash bands find candidates among the rest
and the shingle sets themselves decide. Pairs that the bands miss are found by an exact join between the groups, so that no link is left out.

Defined cases: words are lower-cased in A-Z; texts of fewer words than a shingle are one shingle; null texts, texts without words and rows with a null id stay; rows that share an id stay or go together; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import byte_slices, free_names
from threadmill.operators import neardup, setjoin

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Nearly all shingles occur once, so that few buckets tell the frequent ones as well as many would.
_BUCKETS = 1 << 21


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, in ascending order."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in text.encode("utf-8").lower().split()], np.uint64)
    n = min(words, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * _FACTOR
        out ^= out >> np.uint64(32)
    return np.unique(out)


def groups(df: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``group``, the smallest id that the document is linked with: documents are linked whose shingle sets have this Jaccard similarity or more, directly or through others."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            found = [shingles(x, words) for x in batch.column(1).to_pylist()]
            kept = [k for k, x in enumerate(found) if len(x)]
            yield batch.column(0).take(pa.array(kept, pa.int64())), [found[k] for k in kept]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in parts(batches):
            ends = np.cumsum([0, *map(len, found)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array([setjoin.key(x) for x in found], pa.binary()), sets], ["id", "k", "h"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    sets = setjoin.Hashed(rows, listed, _BUCKETS)
    found = neardup.linked(sets.marked(14, 6), lambda ids: sets.of(ids).select("id", F.col("h").alias("s")), threshold)
    return setjoin.whole(found, sets, threshold)


def dedup(df: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each group, that with the smallest id."""
    gone, = free_names(df, "gone")
    later = groups(df, words, threshold, id_col, text_col).where("id <> group").select(F.col("id").alias(gone))
    return df.join(later, F.col(id_col) == F.col(gone), "left_anti")
