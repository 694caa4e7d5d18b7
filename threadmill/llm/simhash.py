"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

Bits are grouped into partitions by their correlation over all fingerprints. If each partition i has a
threshold T_i (-1: not used) and the T_i + 1 add up to radius + 1, two fingerprints within the radius
differ in at most T_i bits in some partition i. For each fingerprint a dynamic program picks the thresholds with the
fewest expected candidates, by distance histograms of short runs of bits; the fingerprint then probes
all values within T_i of its own in partition i, and every hit is verified on all 64 bits.

Where even the cheapest thresholds promise more than ``dense`` candidates - in the midst of a large group
of similar texts - a fingerprint takes an exact way that never enumerates pairs: for radius 2, two fingerprints are within the
radius if and only if they share one of the 65 values at distance 0 or 1 from either, so it is linked to those
values instead. Pairs of which one side is sparse are found from the sparse side's probes.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are linked like any other; a null id
never becomes a component's id unless all ids are null; repeated rows give repeated results; extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import free_names, materialise
from threadmill.llm.graph import components

BITS = 64
#: Fingerprints of a thousandth of all rows, of which there are a thousand at most, meet their component by a broadcast, so that their rows stay where they are.
HOT = 1000
#: Bits of the runs whose histograms estimate candidates: 2 to this power counters each, whatever the data.
RUN = 11


def _fingerprint(text: str, words_each: int, seed: int) -> int:
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        parts = [b" ".join(words)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[: -words_each] + 1)).tolist()
        parts = [whole[a:b] for a, b in zip(starts, ends[words_each - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(p, seed) for p in parts], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, seed: int = 42) -> DataFrame:
    """The id and ``fp`` (long): a bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles, in A-Z lower case, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([_fingerprint(x or "", words_each, seed) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_groups(together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown from the most correlated bit left. together: 64 x 64 counts of bits that are both 1, with the number of fingerprints as the last row's last entry."""
    n = max(together[BITS, BITS], 1)
    p = together.diagonal()[:BITS] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _together(fps: DataFrame) -> np.ndarray:
    """Counts of bit pairs over all fingerprints; 65 x 65 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 1 << 16):
                bits = np.c_[_bits(fp[at : at + (1 << 16)]), np.ones(len(fp[at : at + (1 << 16)]))].astype(np.float32)
                total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS + 1, BITS + 1))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def _value(bits: np.ndarray, columns: list[int]) -> np.ndarray:
    """The given bits as one number for each row."""
    return bits[:, columns].astype(np.int64) @ (1 << np.arange(len(columns), dtype=np.int64))


class Plan:
    """Partitions of the bits, with what estimates the candidates at each threshold."""

    def __init__(self, groups: list[list[int]], radius: int) -> None:
        self.groups, self.radius = groups, radius
        self.runs = [[g[a : a + RUN] for a in range(0, len(g), RUN)] for g in groups]
        self.near: list[list[np.ndarray]] = []

    def flat_runs(self) -> list[list[int]]:
        return [r for runs in self.runs for r in runs]

    def learn(self, counts: dict[int, np.ndarray]) -> None:
        """counts: of the values of each run. Keeps the share of fingerprints at each exact distance from each value."""
        k = 0
        for runs in self.runs:
            self.near.append([])
            for run in runs:
                have = counts.get(k, np.zeros(1 << len(run)))
                total = max(have.sum(), 1)
                at, values = [], np.arange(1 << len(run))
                for d in range(self.radius + 1):
                    masks = [sum(1 << i for i in c) for c in combinations(range(len(run)), d)]
                    at.append(sum((have[values ^ m] for m in masks), np.zeros(len(have))) / total)
                self.near[-1].append(np.array(at))
                self.total = total
                k += 1

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """Expected candidates and probes of each fingerprint, for each partition and T + 1 from 0 to radius + 1."""
        out = np.zeros((len(self.groups), self.radius + 2, len(bits)))
        for g, (runs, near) in enumerate(zip(self.runs, self.near)):
            dist = np.zeros((self.radius + 1, len(bits)))
            dist[0] = 1
            for run, share in zip(runs, near):
                here = share[:, _value(bits, run)]
                dist = np.array([sum(dist[a] * here[d - a] for a in range(d + 1)) for d in range(self.radius + 1)])
            probes = np.cumsum([len(list(combinations(range(len(self.groups[g])), d))) for d in range(self.radius + 1)])
            out[g, 1:] = np.cumsum(dist, 0) * self.total + probes[:, None]
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each fingerprint the T of each partition, and their cost: dynamic programming over partitions and what is left of radius + 1."""
        cost, want = self.costs(bits), self.radius + 1
        best = np.full((want + 1, len(bits)), np.inf)
        best[0] = 0
        picks = []
        for g in range(len(self.groups)):
            step, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for s in range(want + 1):
                for t in range(s + 1):
                    better = (total := best[s - t] + cost[g, t]) < step[s]
                    step[s], pick[s] = np.where(better, total, step[s]), np.where(better, t, pick[s])
            best = step
            picks.append(pick)
        left, out = np.full(len(bits), want), []
        for pick in reversed(picks):
            out.append(pick[left, np.arange(len(bits))])
            left = left - out[-1]
        return np.array(out[::-1]) - 1, best[want]


def plan(fps: DataFrame, radius: int = 2, choices: tuple[int, ...] = (2, 3, 4)) -> Plan:
    """The number of partitions, of those offered, that costs least over all fingerprints. Histograms of 2 ** RUN counters a run and 65 x 65 bit counts reach the driver, whatever the data."""
    together = _together(fps)
    plans = [Plan(bit_groups(together, m), radius) for m in choices]
    runs = [p.flat_runs() for p in plans]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(p, k): np.zeros(1 << len(r), np.int64) for p, rs in enumerate(runs) for k, r in enumerate(rs)}
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            for (p, k), have in held.items():
                have += np.bincount(_value(bits, runs[p][k]), minlength=len(have))
        for (p, k), have in held.items():
            v = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), p, np.int32)), pa.array(np.full(len(v), k, np.int32)), pa.array(v.astype(np.int32)), pa.array(have[v])], ["p", "k", "v", "n"])

    counts: list[dict[int, np.ndarray]] = [{} for _ in plans]
    for r in fps.select("fp").mapInArrow(count, "p int, k int, v int, n bigint").groupBy("p", "k", "v").agg(F.sum("n").alias("n")).collect():
        counts[r.p].setdefault(r.k, np.zeros(1 << len(runs[r.p][r.k])))[r.v] = r.n
    for p, c in zip(plans, counts):
        p.learn(c)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plans))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy())
            total += [p.thresholds(bits)[1].sum() for p in plans]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(plans), dtype=np.int32)), pa.array(total)], ["p", "cost"])

    cost = {r.p: r.cost for r in fps.select("fp").mapInArrow(weigh, "p int, cost double").groupBy("p").agg(F.sum("cost").alias("cost")).collect()}
    return plans[min(range(len(plans)), key=lambda p: (cost.get(p, 0), p))]


def links(fps: DataFrame, radius: int = 2, dense: float = 256.0) -> DataFrame:
    """Links ``u``, ``v`` between distinct fingerprints ``fp`` that join exactly those within the radius, directly or through values between them.

    ``dense`` chooses between two exact ways and cuts nothing; other radii than 2 have the probes only."""
    chosen = plan(fps, radius)
    hub_over = dense if radius == 2 else np.inf

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 4096):
                yield from _rows(fp[at : at + 4096])

    def _rows(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = _bits(fp)
        ts, cost = chosen.thresholds(bits)
        crowded = cost > hub_over

        def rows(kind: int, part: int, key: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            n = len(key)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(np.full(n, part, np.int8)), pa.array(key.astype(np.int64)), pa.array(of)], ["kind", "part", "key", "fp"])

        for g, columns in enumerate(chosen.groups):
            value = _value(bits, columns)
            yield rows(0, g, value, fp)
            for t in range(radius + 1):
                asks = (ts[g] >= t) & ~crowded
                if asks.any():
                    masks = np.array([sum(1 << i for i in c) for c in combinations(range(len(columns)), t)], np.int64)
                    yield rows(1, g, (value[asks][:, None] ^ masks).ravel(), np.repeat(fp[asks], len(masks)))
        if crowded.any():
            masks = np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64)))).astype(np.uint64).view(np.int64)
            yield rows(2, 0, (fp[crowded][:, None] ^ masks).ravel(), np.repeat(fp[crowded], len(masks)))

    keyed = materialise(fps.select("fp").mapInArrow(emit, "kind tinyint, part tinyint, key bigint, fp bigint"), "probes")
    index, asked = (keyed.where(F.col("kind") == k).select("part", "key", F.col("fp").alias(name)) for k, name in ((0, "v"), (1, "u")))
    found = asked.join(index, ["part", "key"]).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).where("u <> v").select("u", "v")
    hub = keyed.where("kind = 2").select("key", "fp")
    least = hub.groupBy("key").agg(F.min("fp").alias("u"))
    return found.union(hub.join(least, "key").where("u <> fp").select("u", F.col("fp").alias("v")))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """The id, ``fp`` (long) and ``component_id``: the smallest id of all documents that are reachable by links of at most ``radius`` differing bits."""
    fps = materialise(fingerprints(df, id_col, text_col, words_each), "fingerprints")
    first = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "distinct")
    tree = components(links(first, radius))
    rooted = first.join(tree, first.fp == tree.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "component_id", "n"), "components")
    total = named.agg(F.sum("n").alias("n")).first().n or 0
    frequent = F.broadcast(named.where(F.col("n") * HOT >= total).select(F.col("fp").alias("of"), F.col("component_id").alias("known")))
    tagged = fps.join(frequent, F.col("fp") == F.col("of"), "left")
    rare = tagged.where("of is null").join(named, "fp").select(id_col, "fp", "component_id")
    return tagged.where("of is not null").select(id_col, "fp", F.col("known").alias("component_id")).unionByName(rare)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 3, radius: int = 2) -> DataFrame:
    """All columns of the one document of each group that has the smallest id; of repeated rows with that id one stays. Rows with a null id have no place in a group and stay."""
    found = materialise(groups(df.where(F.col(id_col).isNotNull()), id_col, text_col, words_each, radius), "groups")
    (name,) = free_names(df, "gone")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    kept = df.join(gone, F.col(id_col) == F.col(name), "left_anti")
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.where(F.col(id_col).isNull()))


def component_ids(df: DataFrame) -> DataFrame:
    return groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
