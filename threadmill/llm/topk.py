"""Exact top-k search by inner product: tiled matrix products, a partial selection per tile, and a tree of merges.

Queries are written to the shared folder in files of bounded size. Every task holds ``GROUP`` bytes of candidates at a time, takes one query file after the
other, and multiplies it with the candidates in tiles; the query set is neither broadcast nor paired with rows outside these products. Of each tile a query
keeps its k best, of all tiles of the group one running list of k, and these lists are merged in rounds of a fixed fan-in, by windows over
(query, group of tasks).

Components x become floor(scale * x) in double precision and scores are integers. Rows whose components are so small that no
partial sum can pass 2 ** 53 go by matrix products in float64. A row with larger ones is bounded from below and above by a product in float64 and its
rounding error, and only candidates that may still be among the k best are summed in Python integers; such scores are clamped to the range of a long.
Defined cases: vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no
part; a query meets only vectors of its own length, and never rows of its own id; of queries that share an id the
smallest vector counts, of candidates that share an id each row does; ties go to the smaller id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import materialise, scratch_uri

#: Queries of a file, candidates of a tile, bytes of candidates that a task holds, lists that one merge takes.
QUERIES, TILE, GROUP, FAN_IN = 2048, 8192, 64 << 20, 64
_MOST = (1 << 63) - 1


def _usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


def _matrices(ids: np.ndarray, column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer-valued rows, of one length each."""
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        with np.errstate(over="ignore"):
            yield ids[rows], np.nan_to_num(np.floor(scale * flat[begins[rows][:, None] + np.arange(n)].astype(np.float64)))


def _product(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, as flat columns, by one product of small integers. Ids of candidates ascend."""
    ranked = (q @ c.T).astype(np.int64) * len(c) + np.arange(len(c))[::-1]
    ranked[q_ids[:, None] == c_ids] = -_MOST - 1
    if len(c) > k:
        keep = np.argpartition(ranked, len(c) - k, axis=1)[:, len(c) - k :]
        ranked = np.take_along_axis(ranked, keep, 1)
    who, at = np.nonzero(ranked != -_MOST - 1)
    value = ranked[who, at]
    return q_ids[who], c_ids[len(c) - 1 - value % len(c)], value // len(c)


def _bounded(i: int, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Ids and scores of the k best candidates of one query, whatever the size of the components. Ids of candidates ascend."""
    c_ids, c = c_ids[other := c_ids != i], c[other]
    if not len(c):
        return [], []
    with np.errstate(all="ignore"):
        near, error = c @ q, (np.abs(c) @ np.abs(q)) * (len(q) + 2) * 2.0**-52 + 1
        low, high = np.nan_to_num(near - error, nan=-np.inf), np.nan_to_num(near + error, nan=np.inf, posinf=np.inf)
    low, high = np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63)
    least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
    maybe, whole = np.flatnonzero(high >= least), [int(x) for x in q]
    scores = []
    for j in maybe.tolist():
        if low[j] >= 2.0**63:
            scores.append(_MOST)
        elif high[j] <= -(2.0**63):
            scores.append(-_MOST - 1)
        else:
            scores.append(max(-_MOST - 1, min(_MOST, sum(a * int(b) for a, b in zip(whole, c[j].tolist())))))
    order = sorted(range(len(scores)), key=lambda at: (-scores[at], int(c_ids[maybe[at]])))[:k]
    return [int(c_ids[maybe[at]]) for at in order], [scores[at] for at in order]


def _first(columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query among flat columns of query, candidate and score."""
    a, b, s = (np.concatenate([c[i] for c in columns]) for i in range(3))
    order = np.lexsort((b, ~s, a))
    a, b, s = a[order], b[order], s[order]
    begins = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    inside = np.arange(len(a)) - np.repeat(begins, np.diff([*begins, len(a)]))
    return a[inside < k], b[inside < k], s[inside < k]


def _best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in a tile whose ids ascend, as flat columns."""
    most = np.sqrt(2.0**61 / (q.shape[1] * 2 * TILE))
    small_q, small_c = np.abs(q).max(1) < most, np.abs(c).max(1) < most
    parts = [(np.zeros(0, np.int64),) * 3]
    if small_q.any() and small_c.any():
        parts.append(_product(q_ids[small_q], q[small_q], c_ids[small_c], c[small_c], k))
    for at in range(len(q)):
        meets = ~small_c if small_q[at] else slice(None)
        ids, scores = _bounded(int(q_ids[at]), q[at], c_ids[meets], c[meets], k) if not small_q[at] or not small_c.all() else ([], [])
        if ids:
            parts.append((np.full(len(ids), q_ids[at]), np.array(ids, np.int64), np.array(scores, np.int64)))
    return _first(parts, k) if len(parts) > 2 else parts[-1]


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Tiles of candidates, as many together as have at most so many bytes, or one."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            tile = batch.slice(at, TILE)
            if held and size + tile.nbytes > most:
                yield held
                held, size = [], 0
            held.append(tile)
            size += tile.nbytes
    if held:
        yield held


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, the candidate's id and ``score``: for every query its k highest scores, all if there are fewer."""
    spark = candidates.sparkSession
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & _usable(F.col("vec")))
    asked = materialise(clean(queries).groupBy("id").agg(F.min("vec").alias("vec")), "asked")
    path = scratch_uri(spark, "queries")
    asked.repartition(max(1, -(-asked.count() // QUERIES))).write.parquet(path)

    written = spark.read.parquet(path).select("_metadata.file_path").distinct().count()

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet"))
        if len(files) != written:
            raise OSError(f"{len(files)} of {written} files of queries were found below {path}")
        part = TaskContext.get().partitionId()
        for group in _groups(batches, GROUP):
            for name in files:
                with store.open_input_file(name) as file:
                    asks = pq.read_table(file).combine_chunks()
                if not asks.num_rows:
                    continue
                for q_ids, q in _matrices(asks.column("id").to_numpy(), asks.column("vec").chunk(0), scale):
                    found = []
                    for tile in group:
                        for c_ids, c in _matrices(tile.column(0).to_numpy(), tile.column(1), scale):
                            if q.shape[1] == c.shape[1]:
                                order = np.argsort(c_ids, kind="stable")
                                found = [_first([*found, _best(q_ids, q, c_ids[order], c[order], k)], k)]
                    for a, b, s in found:
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(np.full(len(a), part))], ["query_id", "id", "score", "tile"])

    lists = clean(candidates).mapInArrow(tiles, "query_id bigint, id bigint, score bigint, tile bigint")
    parts = candidates.rdd.getNumPartitions()
    order = [F.col("score").desc(), F.col("id")]
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20, against all rows."""
    return search(vectors, vectors.where("vec_id % 20 = 0"))
