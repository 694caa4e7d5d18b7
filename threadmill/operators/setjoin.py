"""Exact similarity join of sets: prefixes of rare words, held against each other in tiles by size.

Words are ordered by how often a bucket of their hashes occurs, a bounded table that every task gets, so that no word is joined with its count. A set keeps its prefix alone: the first words in that
order, of which two sets that are similar enough must share some; words that no other row has are left out, as they match nothing. Sets are dealt by size class, so that a set meets those of its own class and the next, and within a class in blocks and slices of so
many words. A task holds one block as a list of words, each with its sets by size, and streams the slice past it: a word at some place of a prefix meets the sets alone whose size lets the pair's first common word stand so late. Pairs whose
parities differ too much are dropped where they meet. Next to nothing else leaves a task, and what is left is checked by the 64-bit hashes of all its words, in tiles of sets that are candidates of each other, so that no pair is sent with its sets.

Groups of what is linked start from those that MinHash bands find; the join then looks for links between two groups alone, so that no group's own pairs leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators.graph import components
from threadmill.operators.neardup import MARKS, band_keys, mark
from threadmill.session import forget, written

#: Buckets of hashes whose occurrences are counted, a byte each for every task, and how many are sent together.
BUCKETS, _RANGE = 1 << 24, 1 << 16
BLOCK, SLICE = 1 << 24, 1 << 25
_PIECE = 1 << 20
_FUZZ = 1e-9
#: Longs of the parities of a set of up to _EACH words; twice as many for up to twice the words, and so on. Two sets differ in at least as many words as their parities in bits.
_LONGS, _EACH = 8, 256
#: So many sets of candidates at most are sent to where the others are, instead of all sets to them.
_SENT = 1 << 18
#: Pairs and sets that a tile of the check holds, more or less, and words of the tiles that a task checks at once.
_PAIRS, _SETS, _CHECKED = 1 << 17, 1 << 12, 1 << 22
#: Bytes of text that a task hashes at once.
_BYTES = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
#: Of each byte at each place of a word a random number; their sum is the word's hash. Longer words have a digest.
_TABLE = np.random.default_rng(13).integers(0, 1 << 64, (64, 256), np.uint64)


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *rows])))


def key(h: np.ndarray) -> bytes:
    """128 bits that equal sets share. ``h``: unsigned, in ascending order."""
    return hashlib.blake2b(h.data, digest_size=16).digest()


def word_hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one text after the other, and how many words each text has. Words lie between ASCII white space."""
    whole = b" ".join([b"", *found, b""])
    blob = np.frombuffer(whole, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[blob]))
    begin, size = edge[::2] + 1, edge[1::2] - edge[::2]
    h, alive = np.zeros(len(begin), np.uint64), np.arange(len(begin))
    for k in range(min(len(_TABLE), int(size.max(initial=0)))):
        alive = alive[size[alive] > k] if k else alive
        h[alive] += _TABLE[k][blob[begin[alive] + k]]
    for i in np.flatnonzero(size > len(_TABLE)).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(whole[begin[i] : begin[i] + size[i]], digest_size=8).digest(), "little")
    return h, np.diff(np.searchsorted(begin, np.cumsum([1, *[len(x) + 1 for x in found]])))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


class Hashed:
    """What ``keyed`` gives, made in the tasks that use it, so that no words go back to Spark. ``rows``: id and what else ``cut`` turns into batches of id, k and h, some megabytes each; ``buckets``: see ``ranks``."""

    def __init__(self, rows: DataFrame, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], buckets: int = BUCKETS) -> None:
        self.rows, self.cut, self.buckets, self.kind = rows, cut, buckets, rows.schema["id"].dataType.simpleString()

    def of(self, ids: DataFrame) -> DataFrame:
        """``keyed`` of the rows of these ids."""
        return self.rows.join(ids, "id", "left_semi").mapInArrow(self.cut, f"id {self.kind}, k binary, h array<bigint>")

    def marked(self, bands: int, rows: int) -> DataFrame:
        """``neardup.MARKS`` of all rows; ids are longs."""
        cut = self.cut

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut(batches):
                yield mark(batch.column("id"), (x.values.to_numpy() for x in batch.column("h")), bands, rows)

        return self.rows.mapInArrow(run, MARKS)


def hashed(table: DataFrame) -> Hashed:
    """Of a table that ``keyed`` gave."""
    return Hashed(table.select("id", "k", "h"), lambda batches: batches)


def texts(rows: DataFrame) -> Hashed:
    """Of rows ``id`` and ``text`` the distinct words of the text in lower case, as ``words`` cuts them. Texts without a word and rows without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            h, n = word_hashes(batch.column(1).cast(pa.binary()).to_pylist())
            kept, end = np.flatnonzero(n), np.cumsum(n)
            found = [np.unique(h[end[i] - n[i] : end[i]]) for i in kept.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array([key(x) for x in found], pa.binary()), _lists([x.view(np.int64) for x in found], np.int64)], ["id", "k", "h"])

    return Hashed(rows.where("id is not null and text is not null").select("id", F.lower("text").alias("text")), run)


def keyed(sets: DataFrame) -> DataFrame:
    """``id``, ``k``, which equal sets share, and ``h``, the words' hashes. ``sets``: id and ``w``, a sorted array of distinct words that is not empty."""
    return sets.where("id is not null").select("id", F.unhex(F.md5(F.array_join("w", " "))).alias("k"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def ranks(sets: Hashed) -> np.ndarray:
    """Of each bucket of hashes a rank of 0 to 255 that grows with how often it occurs, twelve for each doubling; 0 if it occurs once at most. A task counts to 255 and no further."""
    buckets, cut = sets.buckets, sets.cut

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int32)
        for batch in cut(batches):
            np.add.at(held, batch.column("h").flatten().to_numpy().view(np.uint64) & np.uint64(buckets - 1), np.int32(1))
        for part in range(buckets // _RANGE):
            n = np.minimum(held[part * _RANGE : (part + 1) * _RANGE], 255).astype(np.uint8)
            if len(at := np.flatnonzero(n)):
                few = 3 * len(at) < _RANGE
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes() if few else b""], pa.binary()), pa.array([(n[at] if few else n).tobytes()], pa.binary())], ["part", "at", "n"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(*[x.to_pylist() for x in batch.columns]):
                total.setdefault(part, np.zeros(_RANGE, np.int64))[np.frombuffer(at, np.uint16) if at else slice(None)] += np.frombuffer(n, np.uint8)
        levels = [np.minimum(255, np.floor(np.log2(np.maximum(n, 1)) * 12)).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array(levels, pa.binary())], ["part", "levels"])

    table = sets.rows.mapInArrow(count, "part int, at binary, n binary").repartition("part").mapInArrow(rank, "part int, levels binary").toArrow()
    out = np.zeros((buckets // _RANGE, _RANGE), np.uint8)
    for part, levels in zip(*[x.to_pylist() for x in table.columns]):
        out[part] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def _longs(n: int) -> int:
    return _LONGS << max(0, math.ceil(n / _EACH) - 1).bit_length()


def _parity(h: np.ndarray, longs: int = _LONGS) -> np.ndarray:
    """Of 64 buckets of hashes for each long whether the set has an odd number."""
    return np.packbits((np.bincount((h >> np.uint64(20)).astype(np.int64) & (64 * longs - 1), minlength=64 * longs) & 1).astype(np.uint8)).view(np.int64)


def prefixes(sets: DataFrame | Hashed, threshold: float) -> DataFrame:
    """``n``, ``p``, the prefix in ascending order but for words that occur once, ``skipped``, the number of those, and ``parity`` of every row with an id, ``k`` and ``h``. Words that get the same number count as one, which can only add candidates."""
    sets = sets if isinstance(sets, Hashed) else hashed(sets)
    rank, buckets, cut = sets.rows.sparkSession.sparkContext.broadcast(ranks(sets)), sets.buckets, sets.cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            sizes, kept, skipped, odd = [], [], [], []
            for x in batch.column("h"):
                h = x.values.to_numpy().view(np.uint64)
                word = np.sort(rank.value[(h & np.uint64(buckets - 1)).astype(np.int64)].astype(np.uint32) << np.uint32(24) | (h >> np.uint64(40)).astype(np.uint32))
                sizes.append(len(h))
                word = word[: len(h) - math.ceil(len(h) * threshold - _FUZZ) + 1]
                skipped.append(int(np.searchsorted(word, np.uint32(1 << 24))))
                kept.append(word[skipped[-1] :].view(np.int32))
                odd.append(_parity(h, _longs(len(h))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array(sizes, pa.int32()), _lists(kept, np.int32), pa.array(skipped, pa.int32()), _lists(odd, np.int64)], ["id", "k", "n", "p", "skipped", "parity"])

    return sets.rows.mapInArrow(run, f"id {sets.kind}, k binary, n int, p array<int>, skipped int, parity array<bigint>")


class _Tile:
    """Sets side by side: sizes, prefixes end to end, where each begins, the number of words before it that occur once, and parities of so many longs."""

    def __init__(self, parts: list[pa.RecordBatch], longs: int, groups: bool) -> None:
        self.ids = pa.chunked_array([x.column("id") for x in parts]).combine_chunks()
        self.n = np.concatenate([x.column("n").to_numpy() for x in parts]).astype(np.int64)
        self.word = np.concatenate([x.column("p").flatten().to_numpy() for x in parts]).view(np.uint32)
        self.start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x.column("p").offsets.to_numpy()) for x in parts]))])
        self.group = np.concatenate([x.column("group").to_numpy() for x in parts]) if groups else None
        odd, width = np.concatenate([x.column("parity").flatten().to_numpy() for x in parts]).view(np.uint64), np.concatenate([np.diff(x.column("parity").offsets.to_numpy()) for x in parts])
        at, folded = np.cumsum(width) - width, np.empty((len(width), longs), np.uint64)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            folded[rows] = np.bitwise_xor.reduce(odd[at[rows, None] + np.arange(w)].reshape(len(rows), w // longs, longs), 1)
        self.half, self.rest = np.ascontiguousarray(folded[:, : longs // 2]), np.ascontiguousarray(folded[:, longs // 2 :])
        skipped = np.concatenate([x.column("skipped").to_numpy() for x in parts])
        self.place = np.arange(len(self.word)) - np.repeat(self.start[:-1] - skipped, np.diff(self.start))


def candidates(sets: DataFrame, threshold: float, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of ids that may be as similar; none that is gets lost. ``sets``: id, n, p, skipped and parity, and for pairs of two groups alone ``group``, a long."""
    groups = "group" in sets.columns
    carried = ["id", "n", "p", "skipped", "parity", *["group"] * groups]
    share, apart = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)
    kind = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + _FUZZ).cast("int")
    sets = sets.where(F.size("p") > 0).withColumn("kind", kind)
    held = {r.kind: r.words for r in sets.groupBy("kind").agg(F.sum(F.size("p")).alias("words")).collect()}
    blocks = {c: -(-w // block) for c, w in held.items()}
    slices = {c: -(-(w + held.get(c + 1, 0)) // slice_) for c, w in held.items()}
    if not held:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b"))
    of = lambda table, at: F.element_at(F.create_map(*[F.lit(x) for c in table.items() for x in c]), at)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    deal = lambda of_: F.pmod(F.xxhash64("id"), of_).cast("long")
    # The smaller set of a pair has the first common word within the places that one as large would leave it.
    early = F.col("n") - F.ceil(F.col("n") * (2 * share) - _FUZZ).cast("int") + 1 - F.col("skipped")
    left = sets.where(early > 0).withColumn("p", F.slice("p", F.lit(1), F.greatest(early, F.lit(1)))).select(F.lit(0).alias("side"), "kind", deal(of(blocks, F.col("kind"))).alias("block"), F.explode(upto(of(slices, F.col("kind")))).alias("slice"), *carried)
    met = sets.select("*", F.explode(F.array(F.col("kind"), F.col("kind") - 1)).alias("other")).where(F.col("other").isin([*held])).drop("kind").withColumnRenamed("other", "kind")
    right = met.select(F.lit(1).alias("side"), "kind", F.explode(upto(of(blocks, F.col("kind")))).alias("block"), deal(of(slices, F.col("kind"))).alias("slice"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("kind", "block", "slice", "side")])
                edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), batch.num_rows]
                for at, end in zip(edges, edges[1:]):
                    if at < end:
                        yield tuple(keys[:3, at].tolist()), int(keys[3, at]), batch.slice(at, end - at)

        stream = pieces()
        head = next(stream, None)
        while head:
            now, parts, small = head[0], [], None
            longs = _longs(int(threshold ** -now[0] * (1 - 1e-6)))
            while head and head[0] == now and head[1] == 0:
                parts.append(head[2])
                head = next(stream, None)
            if parts:
                small = _Tile(parts, longs, groups)
                order = np.argsort(small.n, kind="stable")
                of_size, rank = small.n[order], np.empty(len(order), np.uint64)
                rank[order] = np.arange(len(order), dtype=np.uint64)
                listed = np.sort(small.word.astype(np.uint64) << np.uint64(32) | np.repeat(rank, np.diff(small.start)))
                del parts, rank
            while head and head[0] == now:
                if small is not None:
                    yield from near(_Tile([head[2]], longs, groups), small, order, of_size, listed)
                head = next(stream, None)

    def near(large: _Tile, small: _Tile, order: np.ndarray, of_size: np.ndarray, listed: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a set of ``small`` and one of ``large`` that is not smaller."""
        start, n = large.start, np.repeat(large.n, np.diff(large.start))
        least = np.searchsorted(of_size, n * threshold - _FUZZ, "left").astype(np.uint64)
        most = np.searchsorted(of_size, np.minimum(n, (n - large.place) / share - n) + _FUZZ, "right").astype(np.uint64)
        by = np.argsort(large.word)
        low, high = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        wanted = large.word[by].astype(np.uint64) << np.uint64(32)
        low[by], high[by] = np.searchsorted(listed, wanted | least[by]), np.searchsorted(listed, wanted + most[by])
        found = np.maximum(high - low, 0)
        before = np.concatenate([[0], np.cumsum(found)])
        row = 0
        while row < len(large.n):
            until = max(row + 1, int(np.searchsorted(before[start], before[start[row]] + _PIECE, "right")) - 1)
            a, b = start[row], start[until]
            at = np.arange(int(before[b] - before[a])) - np.repeat(before[a:b] - before[a] - low[a:b], found[a:b])
            x = order[listed[at].astype(np.uint32)]
            y = np.repeat(np.repeat(np.arange(row, until), np.diff(start[row : until + 1])), found[a:b])
            if groups:
                other = small.group[x] != large.group[y]
                x, y = x[other], y[other]
            most_bits = (small.n[x] + large.n[y]) * apart + _FUZZ
            bits = np.bitwise_count(small.half[x] ^ large.half[y]).sum(1, dtype=np.int32)
            close = bits <= most_bits
            x, y, bits, most_bits = x[close], y[close], bits[close], most_bits[close]
            close = bits + np.bitwise_count(small.rest[x] ^ large.rest[y]).sum(1, dtype=np.int32) <= most_bits
            y, x = np.divmod(np.unique(y[close] * len(small.n) + x[close]), len(small.n))
            yield pa.RecordBatch.from_arrays([small.ids.take(pa.array(x)), large.ids.take(pa.array(y))], ["a", "b"])
            row = until

    tiles = sum(blocks[c] * slices[c] for c in held)
    kept = left.unionByName(right).repartition(4 * tiles, "kind", "block", "slice").sortWithinPartitions("kind", "block", "slice", "side")
    id_kind = sets.schema["id"].dataType.simpleString()
    pairs = kept.mapInArrow(run, f"a {id_kind}, b {id_kind}").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common(tile: np.ndarray, side: np.ndarray, a: pa.Array, b: pa.Array, s: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of tiles, sets first and then pairs: which rows are pairs, as often as their ids have sets, and the similarity of each."""
    codes = pa.chunked_array([a, b]).combine_chunks().dictionary_encode().indices
    codes = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    mine, other = (tile * (codes.max() + 2) + x for x in (codes[: len(a)], codes[len(a) :]))
    sets, pairs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sets = sets[np.argsort(mine[sets], kind="stable")]
    lists = s.take(pa.array(sets))
    word = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    start = lists.offsets.to_numpy().astype(np.int64)
    start -= start[0]
    size, held = np.diff(start), mine[sets]

    def of(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.searchsorted(held, wanted[rows], "left"), np.searchsorted(held, wanted[rows], "right")
        n = high - low
        return np.repeat(np.arange(len(rows)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)

    again, x = of(pairs, mine)
    pairs = pairs[again]
    again, y = of(pairs, other)
    pairs, x = pairs[again], x[again]
    order = np.argsort(x, kind="stable")
    pairs, x, y = pairs[order], x[order], y[order]
    common, mark = np.zeros(len(x), np.int64), np.zeros(len(word) + 1, bool)
    edges = [*np.flatnonzero(np.diff(x, prepend=-1)).tolist(), len(x)]
    for at, end in zip(edges, edges[1:]):
        own = word[start[x[at]] : start[x[at] + 1]]
        mark[own] = True
        for k in range(at, end, 1024):
            some = y[k : min(end, k + 1024)]
            n = size[some]
            ends = np.cumsum(n)
            hit = mark[word[np.arange(ends[-1]) + np.repeat(start[some] - ends + n, n)]]
            common[k : k + len(some)] = np.add.reduceat(hit, ends - n, dtype=np.int64)
        mark[own] = False
    return pairs, common / (size[x] + size[y] - common)


def verified(met: DataFrame, owners: DataFrame, hashed_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """``a``, ``b`` and ``similarity`` of those candidates that have at least this one. ``owners``: k and the smallest id of each distinct set; ``hashed_of``: gives what ``keyed`` does for the rows of these ids, from which the sets of candidates alone are kept.

    Pairs are dealt by the least id that the first one is a candidate of, which those of a group of near copies share, and a large group's by blocks of its members; so a set goes to a few tiles, whatever the number of its pairs.
    """
    kind = met.schema["a"].dataType.simpleString()
    asked = written(met.select(F.col("a").alias("id")).union(met.select("b")).distinct().join(owners, "id"), "asked")
    sent = F.broadcast(asked) if asked.count() <= _SENT else asked
    held = written(hashed_of(sent.select("id")).join(sent, ["id", "k"], "left_semi").dropDuplicates(["id", "k"]).select("id", F.col("h").alias("s")), "held")
    forget(asked)
    near = met.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.union(met.select("b", "a")).groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("a"), F.least("u", "v").alias("r"))
    dealt = written(met.join(least, "a").select("r", "a", "b"), "dealt")
    parts = F.ceil(F.greatest(F.sqrt(F.count("*") / _PAIRS), F.approx_count_distinct("a") / _SETS, F.approx_count_distinct("b") / _SETS)).cast("int")
    split = dealt.groupBy("r").agg(parts.alias("parts")).where("parts > 1")
    of = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    tiles = written(dealt.join(split, "r", "left").select(F.struct("r", of("a").alias("i"), of("b").alias("j")).alias("tile"), "a", "b"), "tiles")
    forget(dealt)
    members = tiles.select("tile", F.col("a").alias("id")).union(tiles.select("tile", "b")).distinct().join(held, "id")
    rows = members.select("tile", F.lit(0).alias("side"), F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "s").unionByName(tiles.select("tile", F.lit(1).alias("side"), "a", "b", F.lit(None).cast("array<bigint>").alias("s")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        words = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, words
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            changed = np.flatnonzero(whole.column("first").to_numpy(zero_copy_only=False))
            upto = whole.num_rows if last else int(changed[-1])
            if upto:
                part = whole.slice(0, upto)
                rows, found = _common(np.cumsum(part.column("first").to_numpy(zero_copy_only=False)), part.column("side").to_numpy(), part.column("a"), part.column("b"), part.column("s"))
                kept = found >= threshold
                at = pa.array(rows[kept])
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at), pa.array(found[kept])], ["a", "b", "similarity"])
            waiting = [whole.slice(upto)] if upto < whole.num_rows else []
            words = sum(len(x.column("s").flatten()) for x in waiting)

        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("tile").flatten()
            same = np.ones(batch.num_rows - 1, bool)
            for x in names:
                same &= pc.equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
            head = tuple(x[0].as_py() for x in names)
            first = np.concatenate([[head != before], ~same])
            before = tuple(x[-1].as_py() for x in names)
            waiting.append(pa.RecordBatch.from_arrays([pa.array(first), batch.column("side"), batch.column("a"), batch.column("b"), batch.column("s")], ["first", "side", "a", "b", "s"]))
            words += len(batch.column("s").flatten())
            if words >= _CHECKED:
                yield from done(False)
        if waiting:
            yield from done(True)

    return rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def pairs(sets: DataFrame, threshold: float, **tiles: int) -> DataFrame:
    """``a`` < ``b`` and ``similarity`` of distinct sets that have at least this one; equal sets count once, under the smallest id. ``sets``: as for ``keyed`` or ``texts``; computed three times and never stored but for candidates."""
    given = texts(sets) if "text" in sets.columns else hashed(keyed(sets))
    marks = written(prefixes(given, threshold), "prefixes")
    owners = written(marks.groupBy("k").agg(F.min("id").alias("id")), "owners")
    met = written(candidates(marks.join(owners, ["k", "id"], "left_semi"), threshold, **tiles), "met")
    found = verified(met, owners, given.of, threshold)
    forget(marks, owners)
    return found


def banded(table: DataFrame, bands: int, rows: int) -> DataFrame:
    """``id``, ``k``, ``n``, ``bands`` of MinHash keys and ``parity``, of 512 buckets of words whether the set has an odd number."""
    kind = table.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy().view(np.uint64) for x in batch.column("h")]
            lists = [_lists([band_keys(x, bands, rows) for x in sets], np.int64), _lists([_parity(x) for x in sets], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array([len(x) for x in sets], pa.int32()), *lists], ["id", "k", "n", "bands", "parity"])

    return table.select("id", "k", "h").mapInArrow(run, f"id {kind}, k binary, n int, bands array<bigint>, parity array<bigint>")


def minhash(sets: DataFrame, threshold: float, bands: int, rows: int) -> DataFrame:
    """The same for pairs that meet in a band. Those whose sizes or parities rule the similarity out are dropped where they meet; each other distinct set with its own copies is in the result too, with similarity 1."""
    table = keyed(sets)
    marks = written(banded(table, bands, rows), "bands")
    owners = written(marks.groupBy("k").agg(F.min("id").alias("id")), "owners")
    same = written(marks.select("k", F.col("id").alias("b")).join(owners.withColumnRenamed("id", "a"), "k").where("b <> a").select("a", "b", F.lit(1.0).alias("similarity")), "copies")
    own = marks.join(owners, ["k", "id"], "left_semi").select("id", "n", *[F.col("parity")[i].alias(f"p{i}") for i in range(_LONGS)], F.explode("bands").alias("band"))
    x, y = (own.select("band", *[F.col(c).alias(f"{c}_{side}") for c in own.columns if c != "band"]) for side in ("a", "b"))
    small, large, apart = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), sum(F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(_LONGS))
    most = (small + large) * (1 - threshold) / (1 + threshold) + _FUZZ
    met = written(x.join(y, "band").where("id_a < id_b").where(small >= large * threshold - _FUZZ).where(apart <= most).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "met")
    found = verified(met, owners, lambda ids: table.join(ids, "id", "left_semi"), threshold)
    forget(marks, owners)
    return found.unionByName(same)


def whole(found: DataFrame, sets: Hashed, threshold: float, **tiles: int) -> DataFrame:
    """``found`` with the links that it lacks: ``id`` and ``group`` (longs), the smallest id of those that the row is linked with, directly or through others, by sets of at least this similarity. ``found``: the same as far as it is known, for every id of ``sets``, written; ``sets`` are computed twice."""
    marks = written(prefixes(sets, threshold), "prefixes")
    owners = written(marks.groupBy("k").agg(F.min("id").alias("id")), "owners")
    met = written(candidates(marks.join(owners, ["k", "id"], "left_semi").join(found, "id"), threshold, **tiles), "met")
    forget(marks)
    if met.isEmpty():
        forget(met, owners)
        return found
    root = lambda side, name: found.select(F.col("id").alias(side), F.col("group").alias(name))
    links = written(verified(met, owners, sets.of, threshold).join(root("a", "u"), "a").join(root("b", "v"), "b").select("u", "v").distinct(), "between")
    forget(met, owners)
    if links.isEmpty():
        return found
    return written(found.join(components(links), F.col("group") == F.col("node"), "left").select("id", F.coalesce("root", "group").alias("group")), "groups")
