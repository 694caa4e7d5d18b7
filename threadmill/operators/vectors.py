"""Neighbours by cosine over all rows: blocked products, density clusters, greedy groups and searches.

Rows are dealt by hash to left blocks of some ``BLOCK`` rows and to right slices of some ``SLICE``. The rows of a block are sent to every slice and the other way round; a task holds the matrix of
one block and streams its slice past it, product by product. What it returns, counts, smallest ids or a forest of links, is as long as its block and slice, never as
the pairs, so a group of near copies of any size costs what other rows cost. No row is left out: results are exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components have no neighbours, not themselves either; ids are unique whole numbers; rows with a null id take no part and are not
returned; vectors of different lengths raise; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators.graph import components
from threadmill.session import forget, written

BLOCK, SLICE = 4096, 1 << 18
_PART = 2048
_NONE = np.iinfo(np.int64).max
#: Ids, tags and groups of one side of a product.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def usable(df: DataFrame, id_col: str, vec_col: str, within: str | None = None) -> DataFrame:
    """``id``, ``v`` and ``w``, a hash of the column in whose values neighbours must agree. Written, as it is read in several passes."""
    vector = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return written(df.where(good).select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), (F.xxhash64(within) if within else F.lit(0)).cast("long").alias("w")), "vectors")


def tiled(left: DataFrame, right: DataFrame, each: Callable, schema: str, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """``each(left side, products)`` for every block and slice. Both tables: id, v, w and tag; ``products`` yields a right side and the matrix of cosines with it."""
    n, m = left.count(), right.count()
    blocks, slices = max(1, -(-n // block)), max(1, -(-m // slice_))
    deal = lambda df, kind, own, of, other, others: df.select(F.lit(kind).alias("kind"), F.pmod(F.xxhash64("id"), F.lit(of)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other), "id", "v", "w", "tag")
    rows = deal(left, 0, "block", blocks, "slice", slices).unionByName(deal(right, 1, "slice", slices, "block", blocks))

    def matrix(vectors: pa.ListArray, width: int | None) -> np.ndarray:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(flat) % len(vectors) or (np.diff(vectors.offsets.to_numpy()) != len(flat) // len(vectors)).any() or width not in (None, len(flat) // len(vectors)):
            raise ValueError("vectors differ in length")
        out = flat.reshape(len(vectors), -1)
        out = out / np.abs(out).max(1)[:, None]
        return out / np.linalg.norm(out, axis=1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("block", "slice", "kind")])
                edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(edges, edges[1:]):
                    for at in range(a, b, _PART):
                        yield (int(keys[0, at]), int(keys[1, at])), int(keys[2, at]), batch.slice(at, min(_PART, b - at))

        side = lambda part: tuple(part.column(c).to_numpy() for c in ("id", "tag", "w"))
        stream = pieces()
        head = next(stream, None)
        while head:
            key, parts = head[0], []
            while head and head[0] == key and head[1] == 0:
                parts.append((side(head[2]), matrix(head[2].column("v"), None)))
                head = next(stream, None)
            if parts:
                own: Side = tuple(np.concatenate([p[0][k] for p in parts]) for k in range(3))
                whole = np.concatenate([p[1] for p in parts])

                def products() -> Iterator[tuple[Side, np.ndarray]]:
                    nonlocal head
                    while head and head[0] == key:
                        other = side(head[2])
                        near = whole @ matrix(head[2].column("v"), whole.shape[1]).T
                        if (own[2] != own[2][0]).any() or (other[2] != own[2][0]).any():
                            near[own[2][:, None] != other[2][None, :]] = -2
                        yield other, near
                        head = next(stream, None)

                yield from each(own, products())
            while head and head[0] == key:
                head = next(stream, None)

    return rows.repartition("block", "slice").sortWithinPartitions("block", "slice", "kind").mapInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], [*columns])


def _tagged(df: DataFrame, tag: str = "0L") -> DataFrame:
    return df.select("id", "v", "w", F.expr(tag).cast("long").alias("tag"))


def counts(left: DataFrame, right: DataFrame, least: float, **tiles: int) -> DataFrame:
    """``id`` of the left and ``n``: rows of the right, itself if it is there, whose cosine is ``least`` or more."""

    def each(own: Side, products: Iterator) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(own[0]), np.int64)
        for _, near in products:
            n += np.bitwise_count(np.packbits(near >= least, axis=1)).sum(1, dtype=np.int64)
        yield _batch(id=own[0], n=n)

    return tiled(_tagged(left), _tagged(right), each, "id bigint, n bigint", **tiles).groupBy("id").agg(F.sum("n").alias("n"))


def smallest(left: DataFrame, right: DataFrame, least: float, tag: str = "id", earlier: bool = False, **tiles: int) -> DataFrame:
    """``id`` of the left and ``m``: the smallest tag of the near rows of the right, of those with a smaller id alone where ``earlier``. Rows without any are left out."""

    def each(own: Side, products: Iterator) -> Iterator[pa.RecordBatch]:
        m = np.full(len(own[0]), _NONE)
        for (ids, tags, _), near in products:
            near = near >= least
            if earlier:
                near &= ids[None, :] < own[0][:, None]
            order = np.argsort(tags)
            near = np.take(near, order, axis=1)
            first = near.argmax(1)
            m = np.minimum(m, np.where(near[np.arange(len(m)), first], tags[order][first], _NONE))
        found = m != _NONE
        yield _batch(id=own[0][found], m=m[found])

    return tiled(_tagged(left), _tagged(right, tag), each, "id bigint, m bigint", **tiles).groupBy("id").agg(F.min("m").alias("m"))


def _reached(near: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a matrix of links, where rows with one root are connected as well. Every row and every column is read once or twice, however they are linked."""
    live, open_ = near.any(1), np.ones(near.shape[1], bool)
    _, group = np.unique(root, return_inverse=True)
    asked = np.zeros(group.max(initial=-1) + 1, bool)
    for i in np.flatnonzero(live).tolist():
        if not live[i]:
            continue
        rows, columns, new = [], [], np.array([i])
        while len(new):
            asked[:] = False
            asked[group[new]] = True
            new = np.flatnonzero(asked[group] & live)
            live[new] = False
            rows.append(new)
            met = np.flatnonzero(near[new].any(0) & open_)
            open_[met] = False
            columns.append(met)
            new = np.flatnonzero(near[:, met].any(1) & live)
        yield np.concatenate(rows), np.concatenate(columns)


def forest(rows: DataFrame, least: float, **tiles: int) -> DataFrame:
    """Links ``u``, ``v`` that connect what the near pairs of ``rows`` connect; at most as many from a product as it has rows and columns."""

    def each(own: Side, products: Iterator) -> Iterator[pa.RecordBatch]:
        root = own[0].copy()
        for (ids, _, _), near in products:
            before, other = root, ids.copy()
            root = root.copy()
            for i, j in _reached(near >= least, root):
                other[j] = root[i] = min(root[i].min(), ids[j].min())
            u, v = np.concatenate((before, ids)), np.concatenate((root, other))
            links = np.unique(np.stack((u, v))[:, u != v], axis=1)
            changed = root != before
            links = np.concatenate((links, np.stack((own[0][changed], root[changed]))), axis=1)
            yield _batch(u=links[0], v=links[1])

    return tiled(_tagged(rows), _tagged(rows), each, "u bigint, v bigint", **tiles).where("u <> v").distinct()


def dbscan(df: DataFrame, eps: float, min_samples: int, within: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", **tiles: int) -> DataFrame:
    """All rows with an id, and ``cluster``: the smallest core id of the row's cluster, -1 for noise. A core has ``min_samples`` neighbours at cosine distance ``eps`` or less, itself included; a border row goes to the cluster with the smallest name among its core neighbours, as if clusters were grown in the order of ids. within: a column in whose values neighbours must agree."""
    v = usable(df, id_col, vec_col, within)
    flagged = written(v.join(counts(v, v, 1 - eps, **tiles), "id").withColumn("core", F.col("n") >= min_samples), "cores")
    cores = flagged.where("core")
    roots = components(forest(cores, 1 - eps, **tiles))
    named = written(cores.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).select("id", "v", "w", "root"), "clusters")
    border = smallest(flagged.where("not core"), named, 1 - eps, "root", **tiles)
    found = written(named.select(F.col("id").alias("__id"), F.col("root").alias("cluster")).unionByName(border.select(F.col("id").alias("__id"), F.col("m").alias("cluster"))), "found")
    forget(v, flagged, named)
    keep = [within, id_col] if within else [id_col]
    return df.where(F.col(id_col).isNotNull()).select(*keep).join(found, F.col(id_col) == F.col("__id"), "left").select(*keep, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def condense(df: DataFrame, threshold: float, within: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", rounds: int = 500, **tiles: int) -> DataFrame:
    """All rows with an id, and ``leader``: greedy groups in the order of ids, each row in the group of the first leader that is similar enough, or a leader itself.

    Leaders are found in rounds instead of one row after the other: a row leads as soon as no earlier neighbour is undecided, and drops out as
    soon as an earlier neighbour leads. ``rounds`` guards against endless work: beyond it an error is raised.
    """
    v = usable(df, id_col, vec_col, within)
    open_, leaders = v, []
    for _ in range(rounds):
        if open_.isEmpty():
            break
        waits = smallest(open_, open_, threshold, earlier=True, **tiles).select("id")
        new = written(open_.join(waits, "id", "left_anti"), "leaders")
        gone = smallest(open_.join(new.select("id"), "id", "left_anti"), new, threshold, earlier=True, **tiles).select("id")
        rest = written(open_.join(new.select("id").unionByName(gone), "id", "left_anti"), "open")
        if open_ is not v:
            forget(open_)
        open_ = rest
        leaders.append(new)
    else:
        raise RuntimeError(f"groups did not settle in {rounds} rounds")
    lead = v.limit(0)
    for x in leaders:
        lead = lead.unionByName(x)
    lead = written(lead, "lead")
    members = smallest(v.join(lead.select("id"), "id", "left_anti"), lead, threshold, earlier=True, **tiles)
    found = written(members.select(F.col("id").alias("__id"), F.col("m").alias("leader")), "members")
    forget(v, open_, lead, *leaders)
    keep = [within, id_col] if within else [id_col]
    return df.where(F.col(id_col).isNotNull()).select(*keep).join(found, F.col(id_col) == F.col("__id"), "left").select(*keep, F.coalesce("leader", F.col(id_col)).alias("leader"))


def condensed(df: DataFrame, leaders: DataFrame, author: str, id_col: str = "vec_id") -> DataFrame:
    """Of every group its ``leader``, ``count`` and distinct ``authors``, the largest first. df: rows with an id and an author."""
    per = df.select(id_col, author).join(leaders.select(id_col, "leader"), id_col).groupBy("leader", author).agg(F.count("*").alias("n"))
    return per.groupBy("leader").agg(F.sum("n").alias("count"), F.count(author).alias("authors")).orderBy(F.desc("count"), "leader")


def similar(df: DataFrame, probes: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", **tiles: int) -> DataFrame:
    """``a`` (probe), ``b`` and ``similarity``: all rows whose cosine with a probe is at least the threshold, but for the probe's own id."""

    def each(own: Side, products: Iterator) -> Iterator[pa.RecordBatch]:
        for (ids, _, _), near in products:
            i, j = np.nonzero(near >= threshold)
            apart = own[0][i] != ids[j]
            yield _batch(a=own[0][i[apart]], b=ids[j[apart]], similarity=near[i[apart], j[apart]])

    return tiled(_tagged(usable(probes, id_col, vec_col)), _tagged(usable(df, id_col, vec_col)), each, "a bigint, b bigint, similarity double", **tiles)
