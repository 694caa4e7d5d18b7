"""Shards by a k-d tree over document metadata, with DataFrame functions alone.

A node is split at the weighted median - by bytes - of the metadata dimension that is widest in it, until its leaves hold the
target bytes. Every dimension is a place between 0 and 2 ** 24 - 1: the share of the whole table's extent, numbers on a
logarithmic scale and strings by a hash, so that widths can be compared. A 28-bit hash of the id follows it, so that equal values can be split too.

The tree stays a table: which shards a node still covers follows from the number of shards, its statistics and medians are joins and aggregates. Medians are
exact: each round of a level sums bytes by the next 13 bits of the keys that may still hold the median, and a window over at
most 8192 sums of a node picks the digit. Only sums and extents of the whole table reach the driver. A level reads and
writes the metadata once, never the texts.

Defined cases: null text counts as no bytes, each row as one byte more; nulls and NaN in a dimension are its smallest value; rows
equal in dimensions and id stay together; an empty table gives an empty result; extra input columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import discard, materialise

_PLACE, _TIE, _DIGIT = 24, 28, 13
#: Rows that share a number within a shard before slots are counted up.
_BUCKET = 2_000


def _raw(df: DataFrame, name: str) -> Column:
    """A column's value on the scale of its dimension; null where it has none."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = c.cast("double")
        return F.when(~F.isnan(value), F.least(F.log2(F.greatest(value, F.lit(0.0)) + 1), F.lit(1024.0)))
    return F.crc32(c.cast("string").cast("binary")).cast("double")


def _hash(c: Column) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def _key(k: Column, dims: int) -> Column:
    """The key of the dimension of that number."""
    return reduce(lambda rest, i: F.when(k == i, F.col(f"key{i}")).otherwise(rest), range(dims - 2, -1, -1), F.col(f"key{dims - 1}"))


def _cuts(rows: DataFrame, dims: int) -> DataFrame:
    """node, dim and cut of every node with several leaves: rows up to ``cut`` in ``dim`` are as near its lower leaves' share of bytes as can be."""
    at = [x for i in range(dims) for x in (F.min(F.shiftright(f"key{i}", _TIE)).alias(f"a{i}"), F.max(F.shiftright(f"key{i}", _TIE)).alias(f"b{i}"))]
    stats = rows.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("size"), *at)
    widest = F.lit(dims - 1)
    for i in range(dims - 2, -1, -1):
        wide = reduce(lambda a, b: a & b, [F.col(f"b{i}") - F.col(f"a{i}") >= F.col(f"b{j}") - F.col(f"a{j}") for j in range(i + 1, dims)])
        widest = F.when(wide, i).otherwise(widest)
    nodes = materialise(stats.select("node", widest.alias("dim"), (F.col("size") * F.expr("leaves div 2") / F.col("leaves")).alias("want"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("band")), "nodes")
    for low in range(_PLACE + _TIE - _DIGIT, -1, -_DIGIT):
        digit = F.shiftright(_key(F.col("dim"), dims), low)
        sums = rows.join(nodes, "node").where(F.shiftright(digit, _DIGIT) == F.col("prefix")).groupBy("node", "dim", "want", digit.alias("digit")).agg(F.sum("size").alias("size"))
        order = Window.partitionBy("node").orderBy("digit")
        found = sums.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).where("before < want and before + size >= want")
        before, nodes = nodes, materialise(found.select("node", "dim", (F.col("want") - F.col("before")).alias("want"), F.col("digit").alias("prefix"), F.col("size").alias("band")), "nodes")
        discard(before)
    return nodes.select("node", "dim", (F.col("prefix") - F.when(2 * F.col("want") < F.col("band"), 1).otherwise(0)).alias("cut"))


def placed(df: DataFrame, dims: tuple[str, ...], n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32`` and ``node``, the shard, of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    metadata = materialise(df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[_raw(df, d).alias(f"raw{i}") for i, d in enumerate(dims)]), "metadata")
    ends = [x for i in range(len(dims)) for x in (F.min(f"raw{i}").alias(f"a{i}"), F.max(f"raw{i}").alias(f"b{i}"))]
    total = metadata.agg(F.sum("size").alias("size"), *ends).first()
    if n_shards is None:
        n_shards = max(1, -(-(total["size"] or 0) // target_bytes))
    tie = F.shiftright(_hash(F.col("id")), 32 - _TIE)
    keys = []
    for i in range(len(dims)):
        low, extent = total[f"a{i}"] or 0.0, (total[f"b{i}"] or 0.0) - (total[f"a{i}"] or 0.0)
        place = F.floor((F.col(f"raw{i}") - low) / (extent or 1.0) * ((1 << _PLACE) - 2)) + 1
        keys.append((F.shiftleft(F.coalesce(place, F.lit(0)), _TIE) + tie).alias(f"key{i}"))
    rows = materialise(metadata.select("id", "size", "text_crc32", *keys, F.lit(0).alias("node"), F.lit(n_shards).alias("leaves")), "tree")
    discard(metadata)
    for _ in range((n_shards - 1).bit_length()):
        cuts = _cuts(rows, len(dims)).withColumnRenamed("node", "of")
        lower = F.expr("leaves div 2")
        right, split = _key(F.col("dim"), len(dims)) > F.col("cut"), F.col("of").isNotNull()
        node = F.when(split & right, F.col("node") + lower).otherwise(F.col("node"))
        leaves = F.when(~split, F.col("leaves")).when(right, F.col("leaves") - lower).otherwise(lower)
        before, rows = rows, materialise(rows.join(cuts, F.col("node") == F.col("of"), "left").select("id", "size", "text_crc32", *[f"key{i}" for i in range(len(dims))], node.cast("int").alias("node"), leaves.cast("int").alias("leaves")), "tree")
        discard(before)
    return rows.select("id", "size", "text_crc32", *[f"key{i}" for i in range(len(dims))], "node")


def shards(df: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = ("lang", "source", "n_chars"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard). Give either the number of shards or their target bytes."""
    rows = placed(df, dims, n_shards, target_bytes, id_col, text_col)
    sizes = rows.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("n"))
    parts = sizes.select("of", F.greatest(F.lit(1), F.expr(f"n div {_BUCKET}")).alias("parts"))
    rows = rows.join(parts, F.col("node") == F.col("of")).select("id", "size", "text_crc32", F.col("node").alias("shard"), F.pmod(_hash(F.col("id")), F.col("parts")).alias("bucket"))
    rows = materialise(rows, "buckets")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(bases, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).alias("slot"))


def eight_shards(df: DataFrame) -> DataFrame:
    return shards(df, n_shards=8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
