"""Quality rules with an n-gram perplexity: a modified Kneser-Ney model for each language.

The model is over characters, as a model of words would have nearly as many n-grams as a corpus has words: words in lower case are joined by one space, and
a symbol is a code point of the basic plane in 16 bits; others share the 2048 values of the surrogates, which no text has. Spark counts all 4-grams of
all distinct texts of a language - copies teach once, so that the model does not learn a frequent text by heart - and from them the continuation counts of the lower orders and the counts of counts that set the
discounts. Windows over a context's symbols and a join with the shorter n-gram turn counts into probabilities and back-off weights. They lie in a folder for each language, cut by hash range into
files of some ``most`` n-grams of an order; a task reads those that it looks up and holds of each the 64-bit hashes in ascending order beside the log probabilities; lookups are
binary searches. No n-gram is left out: a larger model has more files, and a task that cannot hold them all takes one after the other. Where all models together are small, a worker holds them all and texts are not moved; else
rows are dealt by language and a salt, and a worker holds one model after the other.

A document's log perplexity is the mean negative log probability of its symbols, to four decimals, so that exact ranks follow from the counts of its values. The distinct texts that pass the base rules set
each language's band, whatever their copies: the median and the quartiles of the log perplexity, the quartiles' distances from it,
or a least width, taken ``spread`` times. They are taken over the texts around the shortest interval that holds half of them, so that
junk which is less than half of a language's texts sets no quartile. What lies outside its language's band is rejected.

Defined cases: null text has no words and fails the base rules; null languages are a group of their own (the empty string); repeated rows
each get a verdict; an empty table gives an empty result; extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.common import byte_slices, discard, materialise, scratch_uri, small

ORDER, WIDTH = 4, 16
#: N-grams of one order in a file of a language's model, and of all models that a worker holds at once.
MOST, HOLD = 1 << 21, 6 << 20
#: Distinct 4-grams that a counting task holds before it passes them on, and rows of a language that one scoring task takes where rows are dealt.
_FLUSH, _DEALT = 1 << 20, 20_000
#: Languages up to which their bands, of three values each, are broadcast, so that a frequent language is not dealt to one task.
_MOST_LANGUAGES = 50_000
#: A side of a band is ``spread`` times at least this share of the median, and at least so many nats.
_LEAST_SHARE, _LEAST_NATS = 0.005, 0.01
#: Widths of the shortest half, on either side of it, within which texts count for the quartiles.
_REACH = 4
#: Characters that count as symbols.
MARKS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"


def symbols(words: list[bytes]) -> np.ndarray:
    """A text's symbols, with the space before its first word."""
    codes = np.frombuffer((b" " + b" ".join(words)).decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    return np.where(codes < 0x10000, codes, 0xD800 + codes % 2048).astype(np.uint64)


def grams(s: np.ndarray) -> np.ndarray:
    """The packed ORDER-gram that ends at each symbol after the first; what lies before the text is space."""
    padded = np.concatenate((np.full(ORDER - 2, 32, np.uint64), s))
    packed = padded[: len(s) - 1].copy()
    for k in range(1, ORDER):
        packed = packed << np.uint64(WIDTH) | padded[k : k + len(packed)]
    return packed


def hashed(packed: np.ndarray) -> np.ndarray:
    """The 64-bit hash of packed n-grams, which no two of one order share."""
    return packed * np.uint64(0x9E3779B97F4A7C15)


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        n = len(known)
        if n < 1 << 21:
            windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
            windows = pairs[:-1] * n + ids[2:]
        _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    return len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, MARKS)), dup, repeated


def _language(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def count(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``n`` (order), ``gram`` and ``count``: of 4-grams how often they occur in distinct texts, of shorter ones how many symbols precede them; and as n + 100 the counts of the counts from 1 to 4. Sums are combined in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                for at in range(0, len(keys), 1 << 17):
                    k = keys[at : at + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(counts[at : at + len(k)].astype(np.int64))], ["lang", "gram", "count"])
            held.clear()

        for batch in (piece for whole in batches for piece in byte_slices(whole, 0)):
            fresh: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if words := text.encode("utf-8").split():
                    fresh.setdefault(lang, []).append(grams(symbols(words)))
            for lang, parts in fresh.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    keys, at = np.unique(np.concatenate((held[lang][0], keys)), return_inverse=True)
                    counts = np.bincount(at, np.concatenate((held[lang][1], counts)))
                held[lang] = keys, counts
            if sum(len(k) for k, _ in held.values()) > _FLUSH:
                yield from passed_on()
        yield from passed_on()

    rows = df.select(F.col(text_col).alias("text"), _language(lang_col).alias("lang")).where("text is not null").distinct()
    top = materialise(rows.mapInArrow(run, "lang string, gram bigint, count bigint").groupBy("lang", "gram").agg(F.sum("count").alias("count")), "grams")
    levels, out = top, top.select("lang", F.lit(ORDER).alias("n"), "gram", "count")
    for n in range(ORDER - 1, 0, -1):
        levels = levels.groupBy("lang", F.col("gram").bitwiseAND((1 << (WIDTH * n)) - 1).alias("gram")).agg(F.count("*").alias("count"))
        out = out.unionByName(levels.select("lang", F.lit(n).alias("n"), "gram", "count"))
    out = materialise(out, "orders")
    discard(top)
    kinds = out.where(F.col("count") <= 4).groupBy("lang", "n", "count").agg(F.count("*").alias("kinds"))
    return out.unionByName(kinds.select("lang", (F.col("n") + 100).alias("n"), F.col("count").alias("gram"), F.col("kinds").alias("count")))


def probabilities(counts: DataFrame) -> DataFrame:
    """``lang``, ``n``, ``back``, ``gram`` and ``v``: the log probability of each n-gram's last symbol, with interpolation, or where ``back`` the log back-off weight of the context ``gram`` of order n; as order 0 what an unseen symbol has."""
    of = [F.coalesce(F.max(F.when(F.col("gram") == k, F.col("count"))), F.lit(0)).alias(f"of{k}") for k in range(1, 5)]
    y = F.when(F.col("of1") > 0, F.col("of1") / (F.col("of1") + 2 * F.col("of2"))).otherwise(0.5)
    cut = lambda k: F.when(F.col(f"of{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"of{k + 1}") / F.col(f"of{k}"), F.lit(0.0)), F.lit(float(k)))).otherwise(0.5 * k)
    cuts = counts.where("n > 100").groupBy("lang", (F.col("n") - 100).alias("n")).agg(*of)
    cuts = small(cuts.select("lang", "n", *[cut(k).alias(f"cut{k}") for k in (1, 2, 3)]), _MOST_LANGUAGES)
    out, lower = None, None
    for n in range(1, ORDER + 1):
        context = Window.partitionBy("lang", "context")
        g = counts.where(F.col("n") == n).join(cuts, ["lang", "n"], "left").withColumn("context", F.shiftrightunsigned("gram", WIDTH))
        g = g.withColumn("less", F.when(F.col("count") == 1, F.col("cut1")).when(F.col("count") == 2, F.col("cut2")).otherwise(F.coalesce("cut3", F.lit(1.5))))
        g = g.withColumn("total", F.sum("count").over(context)).withColumn("back", F.sum("less").over(context) / F.col("total"))
        g = g.withColumn("back", F.when(F.col("back") > 0, F.col("back")).otherwise(1e-4))
        own = (F.col("count") - F.col("less")) / F.col("total")
        if n == 1:
            g = g.withColumn("even", F.col("back") / (F.count("*").over(context) + 1)).withColumn("p", F.col("even") + own)
        else:
            g = g.join(lower, (F.col("lang") == F.col("of")) & (F.col("gram").bitwiseAND((1 << (WIDTH * (n - 1))) - 1) == F.col("shorter"))).withColumn("p", own + F.col("back") * F.col("rest"))
        g = materialise(g.select("lang", "gram", "context", "back", "p", *(["even"] if n == 1 else [])), f"p{n}")
        lower = g.select(F.col("lang").alias("of"), F.col("gram").alias("shorter"), F.col("p").alias("rest"))
        rows = [g.select("lang", F.lit(n).alias("n"), F.lit(False).alias("back"), "gram", F.log("p").alias("v"))]
        if n == 1:
            rows.append(g.groupBy("lang").agg(F.max("even").alias("p")).select("lang", F.lit(0).alias("n"), F.lit(False).alias("back"), F.lit(0).cast("long").alias("gram"), F.log("p").alias("v")))
        else:
            rows.append(g.groupBy("lang", "context").agg(F.max("back").alias("w")).select("lang", F.lit(n).alias("n"), F.lit(True).alias("back"), F.col("context").alias("gram"), F.log(F.least("w", F.lit(1.0))).alias("v")))
        for r in rows:
            out = r if out is None else out.unionByName(r)
    return out


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The file of a language's model that holds a hash."""
    return ((hashes >> 48) + 32768) * slots >> 16


def store_model(counts: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """Write probabilities and weights by hash with a folder for each language, named by a hash, and file; returns ``of`` (the language's hash) and ``sizes``, the entries of each of its files."""
    slots = counts.where("n < 100").groupBy("lang", "n").agg(F.count("*").alias("c")).groupBy("lang").agg(F.ceil(F.max("c") / F.lit(most)).cast("int").alias("slots"))
    rows = probabilities(counts).join(small(slots, _MOST_LANGUAGES), "lang").select(F.xxhash64("lang").alias("of"), "slots", "n", "back", "gram", F.col("v").cast("float").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashed(batch.column("gram").to_numpy().view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(_slot(h, batch.column("slots").to_numpy()).astype(np.int32)), batch.column("n"), batch.column("back"), pa.array(h), batch.column("v")], ["of", "slot", "n", "back", "h", "v"])

    made = rows.mapInArrow(run, "of bigint, slot int, n int, back boolean, h bigint, v float")
    made.repartition("of", "slot", F.pmod("h", F.lit(8))).write.partitionBy("of", "slot").parquet(path)
    held = df_of(counts.sparkSession, path).groupBy("of", "slot").agg(F.count("*").alias("c"))
    return held.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "c"))), lambda x: x["c"]).alias("sizes"))


def df_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n int, back boolean, h bigint, v float, of bigint, slot int").parquet(path)


_held: dict[tuple[str, int, int], tuple[int, dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]]] = {}


def _load(path: str, of: int, slot: int, size: int, hold: int) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """One file's sorted arrays, by order and kind. Those used before stay while all have at most ``hold`` entries together. Raises where entries are missing."""
    if (path, of, slot) not in _held:
        store, folder = fs.FileSystem.from_uri(path)
        found = []
        for info in store.get_file_info(fs.FileSelector(f"{folder}/of={of}/slot={slot}")):
            if info.path.endswith(".parquet"):
                with store.open_input_file(info.path) as file:
                    found.append(pq.read_table(file, columns=["n", "back", "h", "v"]))
        if (there := sum(t.num_rows for t in found)) != size:
            raise OSError(f"{there} of {size} entries of a model were found below {path}")
        n, back, h, v = (np.concatenate([t.column(c).to_numpy() for t in found]) for c in ("n", "back", "h", "v"))
        arrays = {}
        for k in range(ORDER + 1):
            for b in (False, True):
                own = np.flatnonzero((n == k) & (back == b))
                own = own[np.argsort(h[own])]
                arrays[k, b] = h[own], v[own]
        for key in [*_held]:
            if key[0] != path or sum(s for s, _ in _held.values()) + size > hold:
                del _held[key]
        _held[path, of, slot] = size, arrays
    return _held[path, of, slot][1]


class Model:
    """Modified Kneser-Ney with interpolation, as ``store_model`` has written it: a language's sorted hash arrays, of which only those in use are held."""

    def __init__(self, path: str, of: int, sizes: list[int], hold: int = HOLD) -> None:
        self.path, self.of, self.sizes, self.hold = path, of, sizes, hold

    def _find(self, n: int, back: bool, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each, and whether there is one."""
        wanted = hashed(packed).view(np.int64)
        slots = _slot(wanted, len(self.sizes))
        values, hit = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        for slot in np.unique(slots).tolist():
            keys, of = _load(self.path, self.of, slot, self.sizes[slot], self.hold)[n, back]
            own = np.flatnonzero(slots == slot)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
                hit[own] = keys[at] == wanted[own]
                values[own] = np.where(hit[own], of[at], 0.0)
        return values, hit

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each packed 4-gram's last symbol after the others."""
        out, left, add = np.zeros(len(grams)), np.arange(len(grams)), np.zeros(len(grams))
        for n in range(ORDER, 0, -1):
            values, hit = self._find(n, False, grams)
            out[left[hit]] = values[hit] + add[hit]
            left, grams, add = left[~hit], grams[~hit], add[~hit]
            if not len(left):
                break
            if n > 1:
                add = add + self._find(n, True, grams >> np.uint64(WIDTH))[0]
                grams = grams & np.uint64((1 << (WIDTH * (n - 1))) - 1)
            else:
                out[left] = self._find(0, False, np.zeros(1, np.uint64))[0][0] + add
        return out


def score(df: DataFrame, path: str, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold: int = HOLD) -> DataFrame:
    """The id, lang, base figures, ``base_failed``, ``log_perplexity`` (null without words) and the text's ``hash``, by the model below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in byte_slices(whole, 1, rows=512)):
            texts, of = batch.column(1).to_pylist(), batch.column(4).to_numpy()
            figures = np.array([base(x) for x in texts], np.int64).reshape(-1, 5)
            ppl: list[float | None] = [None] * len(texts)
            for k in np.unique(of).tolist():
                rows = [i for i in np.flatnonzero(of == k).tolist() if figures[i, 0]]
                if rows:
                    packed = [grams(symbols(texts[i].encode("utf-8").split())) for i in rows]
                    logs = Model(path, k, batch.column(5)[rows[0]].as_py(), hold).log_p(np.concatenate(packed))
                    ends = np.cumsum([len(p) for p in packed])
                    for i, s, n in zip(rows, np.add.reduceat(logs, np.concatenate(([0], ends[:-1]))), map(len, packed)):
                        ppl[i] = round(float(-s / n), 4)
            failed = (figures[:, 0] < 50) | (100 * figures[:, 4] > 50 * figures[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(figures[:, k]) for k in range(5)], pa.array(failed), pa.array(ppl, pa.float64()), batch.column(3)], names)

    names = [id_col, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "hash"]
    lang = _language(lang_col)
    sizes = small(sizes.withColumnRenamed("of", "o"), _MOST_LANGUAGES)
    rows = df.select(F.col(id_col), F.col(text_col), lang.alias("lang"), F.xxhash64(text_col).alias("hash"), F.xxhash64(lang).alias("of")).join(sizes, F.col("of") == F.col("o"), "left").drop("o")
    if df_of(df.sparkSession, path).count() > hold:
        salts = small(rows.groupBy(F.col("of").alias("o")).agg(F.expr(f"count(*) div {_DEALT} + 1").alias("salts")), _MOST_LANGUAGES)
        rows = rows.join(salts, F.col("of") == F.col("o")).withColumn("salt", F.pmod("hash", F.col("salts"))).repartition("of", "salt").sortWithinPartitions("of").drop("o", "salts", "salt")
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, log_perplexity double, hash bigint")


def _quantiles(texts: DataFrame, shares: list[float]) -> DataFrame:
    """``of`` and ``q``: for each share the value whose rank is that share of all, rounded up. Exact, from the counts of values, of which four decimals leave some hundred thousand a language."""
    counted = texts.groupBy("of", "x").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("of").orderBy("x"))).withColumn("all", F.sum("n").over(Window.partitionBy("of")))
    return upto.groupBy("of").agg(F.array(*[F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("all") * F.lit(round(s * 100)) / 100), F.lit(1)), F.col("x"))) for s in shares]).alias("q"))


def _bands(scored: DataFrame, spread: float) -> DataFrame:
    """``of`` (language), ``low`` and ``high``."""
    texts = scored.where(~F.col("base_failed")).groupBy(F.col("lang").alias("of"), "hash").agg(F.min("log_perplexity").alias("x"))
    least = lambda median: F.greatest(median * _LEAST_SHARE, F.lit(_LEAST_NATS))
    ranks = _quantiles(texts, [k / 100 for k in range(101)])
    half = ranks.select("of", F.expr("array_min(transform(sequence(0, 50), i -> struct(q[i + 50] - q[i] as width, q[i] as a, q[i + 50] as b)))").alias("half"), least(F.expr("q[50]")).alias("least"))
    reach = F.greatest("half.width", 2 * F.col("least")) * _REACH
    half = small(half.select("of", (F.col("half.a") - reach).alias("from"), (F.col("half.b") + reach).alias("to")), _MOST_LANGUAGES)
    near = texts.join(half, "of").where(F.col("x").between(F.col("from"), F.col("to")))
    q = _quantiles(near, [0.25, 0.5, 0.75])
    median, side = F.expr("q[1]"), lambda distance: spread * F.greatest(F.expr(distance), least(F.expr("q[1]")))
    return q.select("of", (median - side("q[1] - q[0]")).alias("low"), (median + side("q[2] - q[1]")).alias("high"))


def verdicts(df: DataFrame, spread: float = 8.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MOST) -> DataFrame:
    """What ``score`` returns, with each language's band ``low``, ``high`` and the verdict ``kept``."""
    path = scratch_uri(df.sparkSession, "model")
    sizes = store_model(count(df, text_col, lang_col), path, most)
    scored = materialise(score(df, path, sizes, id_col, text_col, lang_col), "scores")
    bands = small(_bands(scored, spread), _MOST_LANGUAGES)
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    return scored.join(bands, F.col("lang") == F.col("of"), "left").drop("of", "hash").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def rules(df: DataFrame) -> DataFrame:
    return verdicts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
