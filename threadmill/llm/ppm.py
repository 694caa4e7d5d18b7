"""Scores of a language model: prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER``. In a context the next symbol has its count over the total plus the number of distinct symbols, and
the rest of the probability is the escape to the context without its first byte (method C). Symbols that
the longer context has seen are excluded below it. What no context has seen shares the rest evenly among the 256 symbols: bytes, and as the
end of a text the byte 255, which UTF-8 never has. A text is its words in lower case, joined by one space.

Pretrained scores over a corpus: a task reads texts in blocks of bounded bytes and keeps for a block its texts, its distinct runs of ORDER + 1 bytes and its distinct words, with their
counts in the texts that teach. From the sums over all blocks Spark derives each order of the trie: totals and distinct symbols of a context are windows over its at
most 256 symbols, the shorter context comes by a join. So every run gets its log probability once, with escapes and exclusions, and goes back to the blocks that have it; a task then holds the runs of one
block and scores its texts. The model is never gathered, so it may grow with the corpus, and no n-gram is left out.

Adaptive code lengths: ``adaptive`` learns each text from nothing as it goes.

Defined cases: null text is empty, its only token is the end; a null id counts as the empty string where the fold is drawn; repeated rows
are scored each and teach each; without texts to learn from every symbol has 1/256; very long texts are cut into pieces whose contexts go on; an empty table gives an empty
result; extra input columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import byte_slices, discard, holds, materialise, scratch, settings

ORDER, END = 5, b"\xff"
#: A block ends at so many bytes of text, distinct runs or distinct words.
BLOCK_BYTES, BLOCK_RUNS, BLOCK_WORDS = 32 << 20, 3 << 20, 1 << 19
_PIECE = 1 << 20
#: Dictionary entries that a task packs at once.
_PACK = 1 << 20
_SPACES = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_GRAM, _WORD, _TEXT = 0, 1, 2


def segments(text: str | None, piece: int = _PIECE) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """The text in pieces: the ORDER bytes before a piece, its bytes, and its words. The last ends with END."""
    raw, at, context, begun = (text or "").encode("utf-8").lower().translate(_SPACES), 0, END * ORDER, False
    while True:
        to = raw.find(b" ", at + piece)
        to = len(raw) if to < 0 else to
        words = raw[at:to].split(b" ") if b"  " not in raw[at:to] else raw[at:to].split()
        words = [w for w in words if w]
        body = (b" " if begun and words else b"") + b" ".join(words) + (END if to == len(raw) else b"")
        if body:
            yield context, body, words
        begun, context, at = begun or bool(words), (context + body)[-ORDER:], to
        if at == len(raw):
            return


def runs(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of (context, bytes): the packed run of ORDER + 1 bytes that ends at each byte, and the number of its part."""
    blob = np.frombuffer(b"".join(c + b for c, b in parts), np.uint8).astype(np.int64)
    sizes = np.array([len(b) for _, b in parts], np.int64)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    packed = blob[: len(blob) - ORDER].copy()
    for k in range(1, ORDER + 1):
        packed <<= 8
        packed |= blob[k : k + len(packed)]
    kept = np.ones(len(packed), bool)
    for at in (np.cumsum(sizes + ORDER)[:-1] - ORDER).tolist():
        kept[at : at + ORDER] = False
    return packed[kept], owner


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)


class _Lookup:
    """Values of 64-bit keys in tables of one slot a hash; keys that lose their slot go to the next, smaller table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.levels = []
        while len(keys):
            shift, factor = np.uint64(64 - (2 * len(keys)).bit_length()), np.uint64(0x9E3779B97F4A7C15 + 2 * len(self.levels))
            slot = (keys.view(np.uint64) * factor >> shift).astype(np.int64)
            held, of = np.full(1 << 64 - int(shift), -1), np.zeros(1 << 64 - int(shift))
            held[slot] = keys
            won = held[slot] == keys
            of[slot[won]] = values[won]
            self.levels.append((factor, shift, held, of))
            keys, values = keys[~won], values[~won]

    def get(self, wanted: np.ndarray) -> np.ndarray:
        out, rest = np.zeros(len(wanted)), None
        for factor, shift, held, of in self.levels:
            slot = (wanted.view(np.uint64) * factor >> shift).astype(np.int64)
            hit = held[slot] == wanted
            if rest is None:
                out, rest = of[slot], np.flatnonzero(~hit)
            else:
                out[rest[hit]] = of[slot[hit]]
                rest = rest[~hit]
            wanted = wanted[~hit]
            if not len(rest):
                return out
        raise RuntimeError("a block lacks runs of its texts")


def blocks(df: DataFrame, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """Rows of three kinds, for each block its texts, its runs and its words with their counts ``n`` in texts that teach (0: in others alone). The end of a text is the empty word. To be written before use, as blocks follow from how the rows are dealt to tasks."""
    kind = df.schema[id_col].dataType
    names = ["block", "kind", "gram", "word", "n", "id", "text", "held_out"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), None, pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, grams, words, id_type = TaskContext.get().partitionId() << 32, 0, [], Counter(), None

        def rows(n: int, what: int, /, **columns: pa.Array) -> pa.RecordBatch:
            fixed = {"block": pa.array(np.full(n, block)), "kind": pa.array(np.full(n, what, np.int32))}
            return pa.RecordBatch.from_arrays([(fixed | columns).get(name) if name in fixed or name in columns else pa.nulls(n, t or id_type) for name, t in zip(names, types)], names)

        def finished() -> Iterator[pa.RecordBatch]:
            if grams:
                keys, counts = _sums(grams)
                for at in range(0, len(keys), 1 << 17):
                    part = keys[at : at + (1 << 17)]
                    yield rows(len(part), _GRAM, gram=pa.array(part), n=pa.array(counts[at : at + (1 << 17)]))
            found = [*words]
            for at in range(0, len(found), 1 << 16):
                part = found[at : at + (1 << 16)]
                yield rows(len(part), _WORD, word=pa.array(part, pa.binary()), n=pa.array([words[w] for w in part], pa.int64()))

        for batch in (part for whole in batches for part in byte_slices(whole, 1, _PIECE)):
            id_type = batch.column(0).type
            yield rows(batch.num_rows, _TEXT, id=batch.column(0), text=batch.column(1).cast(pa.string()), held_out=batch.column(2))
            waiting: dict[bool, list[tuple[bytes, bytes]]] = {True: [], False: []}

            def learn() -> None:
                for out, parts in waiting.items():
                    if parts:
                        keys, counts = np.unique(runs(parts)[0], return_counts=True)
                        grams.append((keys, counts * (not out)))
                        parts.clear()
                if sum(len(k) for k, _ in grams) > BLOCK_RUNS:
                    grams[:] = [_sums(grams)]

            for text, out in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for context, body, found in segments(text):
                    waiting[out].append((context, body))
                    size += len(body)
                    if body.endswith(END):
                        found.append(b"")
                    if out:
                        words.update(dict.fromkeys(found, 0))
                    else:
                        words.update(found)
                    if len(body) >= _PIECE:
                        learn()
            learn()
            if size >= BLOCK_BYTES or sum(len(k) for k, _ in grams) >= BLOCK_RUNS or len(words) >= BLOCK_WORDS:
                yield from finished()
                block, size, grams, words = block + 1, 0, [], Counter()
        yield from finished()

    schema = T.StructType([T.StructField(name, t) for name, t in zip(names, [T.LongType(), T.IntegerType(), T.LongType(), T.BinaryType(), T.LongType(), kind, T.StringType(), T.BooleanType()])])
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), held_out).mapInArrow(run, schema)


def _sorted(df: DataFrame) -> DataFrame:
    """For joins with tables that grow with the corpus: their files are many times smaller than their rows in memory, so that Spark would broadcast them by the size of the files."""
    return df.hint("merge")


def _log(x: str) -> Column:
    return F.log10(F.expr(x))


def trie(counted: DataFrame) -> DataFrame:
    """From ``gram`` (ORDER + 1 packed bytes) and its count ``n``, written: ``gram`` and ``log_p``, the log10 probability of its last byte after the others."""
    levels = {ORDER: counted}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = materialise(levels[k + 1].groupBy(F.expr(f"gram & {(1 << 8 * (k + 1)) - 1}L").alias("gram")).agg(F.sum("n").alias("n")), f"order{k}")
    whole = Window.partitionBy()
    now = levels[0].withColumn("t", F.sum("n").over(whole)).withColumn("d", F.count(F.expr("nullif(n, 0)")).over(whole))
    now = now.withColumn("u", F.when(F.col("d") < 256, -_log("256 - d")))
    now = now.withColumn("s", F.expr("case when t = 0 then -log10(256) when n > 0 then log10(n) - log10(t + d) else log10(d) - log10(t + d) + u end"))
    for k in range(1, ORDER + 1):
        below = now.select(F.col("gram").alias("g1"), F.col("n").alias("n1"), F.col("t").alias("t1"), F.col("d").alias("d1"), F.col("u").alias("u1"), F.col("s").alias("s1"))
        # Contexts of one or two bytes are 65 536 at most.
        now = (levels[k] if k <= 2 else _sorted(levels[k])).join(below if k <= 2 else _sorted(below), F.expr(f"gram & {(1 << 8 * k) - 1}L") == F.col("g1"))
        context = Window.partitionBy("context")
        now = now.withColumn("context", F.shiftright("gram", 8)).withColumns({"t": F.sum("n").over(context), "d": F.count(F.expr("nullif(n, 0)")).over(context), "x": F.sum(F.expr("if(n > 0, n1, 0)")).over(context)})
        # After an escape: what the longer context has seen is excluded; a escapes are left in b.
        now = now.withColumns({"a": F.col("d1") - F.col("d"), "b": F.col("t1") - F.col("x") + F.col("d1") - F.col("d")})
        now = now.withColumn("u", F.expr("case when t = 0 or n > 0 then null when n1 > 0 then log10(n1) - log10(b) when a > 0 then log10(a) - log10(b) + u1 else u1 end"))
        now = now.withColumn("s", F.expr("case when t = 0 then s1 when n > 0 then log10(n) - log10(t + d) else log10(d) - log10(t + d) + u end"))
        now = now.select("gram", "n", "t", "d", "u", "s")
    found = materialise(now.select("gram", F.col("s").alias("log_p")), "trie")
    discard(*[levels[k] for k in range(ORDER)])
    return found


def _packed(entries: DataFrame, key: str, value: str, kind: int) -> DataFrame:
    """``block``, ``kind``, ``keys`` and ``numbers``: entries of a block side by side in binary columns, some ``_PACK`` entries of a task at a time. Words are joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by("block").combine_chunks()
            of, numbers = table.column("block").to_numpy(), table.column(value).to_numpy()
            starts = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
            ends = [*starts[1:].tolist(), len(of)]
            keys = table.column(key).to_pylist() if kind == _WORD else table.column(key).to_numpy()
            join = b" ".join if kind == _WORD else np.ndarray.tobytes
            at = [*zip(starts.tolist(), ends)]
            return pa.RecordBatch.from_arrays([pa.array(of[starts]), pa.array(np.full(len(starts), kind, np.int32)), pa.array([join(keys[a:b]) for a, b in at], pa.binary()), pa.array([numbers[a:b].tobytes() for a, b in at], pa.binary())], ["block", "kind", "keys", "numbers"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= _PACK:
                yield packed(held)
                held.clear()
        if held:
            yield packed(held)

    return entries.select("block", key, value).mapInArrow(run, "block bigint, kind int, keys binary, numbers binary")


def scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (words alone) and ``score`` (the trie), both log10 probabilities."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "blocks")
    made = blocks(df, id_col, text_col, held_out)
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": 8}):
        made.write.partitionBy("kind").parquet(path, compression="zstd")

    def of_kind(kind: int) -> DataFrame:
        out = spark.read.schema(made.drop("kind").schema).parquet(f"{path}/kind={kind}") if holds(spark, f"{path}/kind={kind}") else spark.createDataFrame([], made.drop("kind").schema)
        out.scratch_path = f"{path}/kind={kind}"
        return out

    grams, words, texts = of_kind(_GRAM), of_kind(_WORD), of_kind(_TEXT)
    counted = materialise(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    found = trie(counted)
    runs_of = materialise(_packed(_sorted(grams.select("block", "gram")).join(_sorted(found), "gram"), "gram", "log_p", _GRAM), "runs")
    discard(grams, counted, found)
    known = materialise(words.groupBy("word").agg(F.sum("n").alias("n")), "known")
    total = known.agg(F.sum("n").alias("n"), F.count(F.expr("nullif(n, 0)")).alias("v")).first()
    n, low = total.n or 0, (total.n or 0) + 0.1 * (total.v + 1)
    words_of = materialise(_packed(_sorted(words.select("block", "word")).join(_sorted(known), "word"), "word", "n", _WORD), "words")
    discard(words, known)

    empty = lambda name, t: F.lit(None).cast(t).alias(name)
    id_type = df.schema[id_col].dataType
    entry = lambda x: x.select("block", "kind", "keys", "numbers", empty("id", id_type), empty("text", "string"), empty("held_out", "boolean"))
    rows = entry(runs_of).unionByName(entry(words_of)).unionByName(texts.select("block", F.lit(_TEXT).alias("kind"), empty("keys", "binary"), empty("numbers", "binary"), "id", "text", "held_out"))
    out = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, logs, known_words, ready = None, [], [], {}, None

        def scored(part: pa.RecordBatch) -> pa.RecordBatch:
            tokens, hits = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            base, score = np.zeros(part.num_rows), np.zeros(part.num_rows)
            waiting, of = [], []

            def add() -> None:
                packed, owner = runs(waiting)
                np.add.at(score, of, np.bincount(owner, ready.get(packed), minlength=len(waiting)))
                waiting.clear()
                of.clear()

            for i, text in enumerate(part.column("text").to_pylist()):
                for context, body, words in segments(text):
                    if body.endswith(END):
                        words.append(b"")
                    c = np.array([known_words[w] for w in words], np.int64)
                    tokens[i] += len(c)
                    hits[i] += np.count_nonzero(c)
                    base[i] += np.log10((c + 0.1) / low).sum()
                    waiting.append((context, body))
                    of.append(i)
                    if len(body) >= _PIECE:
                        add()
            if waiting:
                add()
            return pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(tokens), pa.array(hits), pa.array(np.full(part.num_rows, n)), pa.array(base), pa.array(score)], out)

        for batch in batches:
            blocks_, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                part = batch.slice(at, to - at)
                if to == at:
                    continue
                if blocks_[at] != block:
                    block, keys, logs, known_words, ready = blocks_[at], [], [], {}, None
                if kinds[at] == _GRAM:
                    keys += [np.frombuffer(x, np.int64) for x in part.column("keys").to_pylist()]
                    logs += [np.frombuffer(x, np.float64) for x in part.column("numbers").to_pylist()]
                elif kinds[at] == _WORD:
                    for x, c in zip(part.column("keys").to_pylist(), part.column("numbers").to_pylist()):
                        known_words.update(zip(x.split(b" "), np.frombuffer(c, np.int64).tolist()))
                else:
                    if ready is None:
                        ready, keys, logs = _Lookup(np.concatenate(keys), np.concatenate(logs)), [], []
                    for piece in byte_slices(part, part.schema.get_field_index("text"), _PIECE):
                        yield scored(piece)

    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in out[2:5]], *[T.StructField(x, T.DoubleType()) for x in out[5:]]])
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, schema).withColumnRenamed("id", id_col)


class Trie:
    """Contexts of one text, that grow with it."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.seen: dict[bytes, dict[int, int]] = {}

    def log2_p(self, context: bytes, symbol: int) -> float:
        out, excluded = 0.0, frozenset()
        for k in range(min(self.order, len(context)), -1, -1):
            after = self.seen.get(context[len(context) - k :])
            if not after:
                continue
            left = {s: c for s, c in after.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log2(left[symbol] / total)
            if left:
                out += math.log2(len(left) / total)
            excluded = after.keys()
        return out - math.log2(256 - len(excluded))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            after = self.seen.setdefault(context[len(context) - k :], {})
            after[symbol] = after.get(symbol, 0) + 1


def adaptive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """id, ``n_symbols`` (bytes and the end) and ``bits``: the code length of each text by a trie that has seen what stands before in the same text. The trie, and so memory, grows with one text."""

    def bits(text: str | None) -> tuple[int, float]:
        model, n, total, before = Trie(order), 0, 0.0, END * order
        for _, body, _ in segments(text):
            for symbol in body:
                total -= model.log2_p(before, symbol)
                model.learn(before, symbol)
                before = (before + bytes((symbol,)))[-order:] if order else b""
                n += 1
        return n, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in byte_slices(whole, 1)):
            found = [bits(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.float64())], [id_col, "n_symbols", "bits"])

    schema = T.StructType([df.schema[id_col], T.StructField("n_symbols", T.LongType()), T.StructField("bits", T.DoubleType())])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def tenth_held_out(df: DataFrame) -> DataFrame:
    """Scores of all documents by those whose id's CRC-32 is not divisible by 10."""
    return scores(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
