"""Audit of how far sources of one language differ in their use of words, and which words set a source apart.

Terms are counted in the tasks and summed by language, source and term. A language keeps the terms of enough of its documents. With
smoothed shares in whole numbers of a thousand millionth, two sources differ by the sum of the distances of their shares over all kept terms.

The sums are taken by two-dimensional tiling. A language's sources lie in blocks of some ``BLOCK`` and its terms in chunks of some ``CHUNK``,
both dealt by hash, so that either can be numbered without one task that sees all. The counts of a block and chunk
are packed into one row, and each row is replicated to the tiles, pairs of blocks, that need it. A task takes a tile's packed rows chunk after chunk, in
order, and adds up the submatrix of its pairs; it holds two packed rows and that submatrix, however many terms there are. A tile's chunks are cut into
spans of ``SPAN``, whose submatrices are added up, so that few tiles with very many terms are still shared by many tasks.

Defined cases: null text, language and source are empty strings; rows are documents, whatever their ids; a language without kept terms has distances 0
and no terms; groups of one source have no pairs; an empty table gives an empty result; extra input columns are not read. Counts of a group
and language must stay below 9e15, which is checked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import byte_slices, materialise, small

BLOCK, CHUNK, SPAN = 64, 512, 16
#: Distinct terms that a counting task holds before it passes them on.
_FLUSH = 400_000
#: Rows up to which the tables of languages and of sources are broadcast.
_MOST = 50_000
#: What a share is counted in, and what is added to each count.
SCALE, SMOOTH = 1_000_000_000, 5
_LETTERS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str, piece: int = 4 << 20) -> Iterator[list[bytes]]:
    """The terms of a text (runs of ASCII letters, in lower case, and of code points from 128), in lists from some so many bytes each."""
    raw = text.encode("utf-8").translate(_LETTERS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + piece)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``count`` (occurrences) and ``docs``; added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (count, docs) in held.items():
                found = [*count]
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array([source] * n), pa.array(part, pa.binary()).cast(pa.string()), pa.array([count[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "count", "docs"])
            held.clear()

        for batch in (piece for whole in batches for piece in byte_slices(whole, 0)):
            for text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in terms(text):
                    count.update(part)
                    seen.update(part)
                docs.update(seen)
            if sum(len(c) for c, _ in held.values()) > _FLUSH:
                yield from passed_on()
        yield from passed_on()

    rows = df.select(_text(text_col).alias("text"), _text(lang_col).alias("lang"), _text(source_col).alias("source"))
    return rows.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """The smoothed share, exact; 0 where the language has no term."""
    return F.expr(f"if(v = 0, 0L, 1 + (cast({count} as decimal(20,0)) + {SMOOTH}) * cast({SCALE} as decimal(10,0)) div ({total} + {SMOOTH} * v))").cast("long")


def _tiles(packed: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``i``, ``b``, ``j``, ``value``: of each pair of a source of block a and one of block b once, for each span, the sum of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, chunk, low = None, None, None, None

        def matrix(row: dict, cells: pa.StructArray) -> np.ndarray:
            out = np.repeat(np.array(row["bases"], np.int64)[:, None], row["width"], 1)
            if len(cells):
                out[cells.field("place").to_numpy(), cells.field("slot").to_numpy()] = cells.field("p").to_numpy()
            return out

        def finished() -> Iterator[pa.RecordBatch]:
            if key is not None:
                lang, a, b, _ = key
                i, j = np.nonzero(np.triu(np.ones_like(total), 1) if a == b else np.ones_like(total))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i)), pa.array([a] * len(i), pa.int64()), pa.array(i.astype(np.int32)), pa.array([b] * len(i), pa.int64()), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["lang", "a", "i", "b", "j", "value"])

        for batch in batches:
            rows = batch.drop_columns(["cells"]).to_pylist()
            for k, row in enumerate(rows):
                cells = batch.column("cells")[k].values
                if (now := (row["lang"], row["a"], row["b"], row["span"])) != key:
                    yield from finished()
                    key, total, chunk = now, None, None
                m = matrix(row, cells)
                if row["a"] != row["b"] and chunk != row["chunk"]:
                    chunk, low = row["chunk"], m
                    continue
                left = m if row["a"] == row["b"] else low
                if total is None:
                    total = np.zeros((len(left), len(m)), np.int64)
                for i in range(len(left)):
                    total[i] += np.abs(m - left[i]).sum(1)
        yield from finished()

    key = ["lang", "a", "b", "span"]
    return packed.repartition(*key).sortWithinPartitions(*key, "chunk", "block").mapInArrow(run, "lang string, a bigint, i int, b bigint, j int, value bigint")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: as ``pair`` every other source of the language by its distance, as ``term`` the ``top`` terms that the source uses more than its language by the excess of their share."""
    cells = materialise(counts(df, text_col, lang_col, source_col), "cells")
    words = materialise(cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("of_lang")).where(F.col("docs") >= least_docs), "words")
    sizes = small(words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total")), _MOST)
    dealt = words.join(sizes, "lang").withColumn("chunk", F.expr(f"pmod(xxhash64(term), ceil(v / {CHUNK}))"))
    words = materialise(dealt.select("lang", "term", "of_lang", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("slot")), "chunks")
    kept = materialise(cells.select("lang", "source", "term", "count").join(words, ["lang", "term"]), "kept")

    every = df.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct()
    groups = every.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left")
    blocks = small(every.groupBy("lang").agg(F.expr(f"ceil(count(*) / {BLOCK})").alias("blocks")), _MOST)
    groups = groups.join(blocks, "lang").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("total", F.expr(f"if(lang_total + {SMOOTH} * v < 9e15, total, raise_error('too many terms'))"))
    groups = groups.withColumn("block", F.expr("pmod(xxhash64(source), blocks)")).withColumn("place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1)
    groups = small(materialise(groups.withColumn("base", _share("0", "total")), "groups"), _MOST)

    shares = kept.join(groups.select("lang", "source", "total", "v", "lang_total", "block", "place"), ["lang", "source"]).select("lang", "source", "term", "block", "place", "chunk", "slot", _share("count", "total").alias("p"), _share("of_lang", "lang_total").alias("q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    excess = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    excess = excess.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    widths = words.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    members = groups.groupBy("lang", "block", "blocks", "v").agg(F.expr("transform(sort_array(collect_list(struct(place, base))), x -> x.base)").alias("bases"))
    frames = members.select("lang", "block", "blocks", "bases", F.explode(F.expr(f"sequence(0L, greatest(ceil(v / {CHUNK}), 1) - 1)")).alias("chunk"))
    lists = shares.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("place", "slot", "p")).alias("cells"))
    packed = frames.join(widths, ["lang", "chunk"], "left").join(lists, ["lang", "block", "chunk"], "left")
    packed = materialise(packed.select("lang", "block", "blocks", "chunk", "bases", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("cells", F.expr("cast(array() as array<struct<place:int,slot:int,p:bigint>>)")).alias("cells")), "packed")
    tiles = packed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.expr(f"chunk div {SPAN}").alias("span"), "chunk", "block", "bases", "width", "cells")
    sums = _tiles(tiles).groupBy("lang", "a", "i", "b", "j").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("j").alias("i"), F.col("a").alias("b"), F.col("i").alias("j"), "value"))
    name = lambda block, place, to: groups.select("lang", F.col("block").alias(block), F.col("place").alias(place), F.col("source").alias(to))
    pairs = both.join(name("a", "i", "source"), ["lang", "a", "i"]).join(name("b", "j", "item"), ["lang", "b", "j"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(excess)
