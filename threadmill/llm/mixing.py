"""Mixing sources to target weights by temperature, with DataFrame functions alone.

Source shares p become weights proportional to p ** a. The exponent a is bisected to the largest value at which
the weights' entropy reaches its target; if some source were then repeated beyond the limit, a second bisection moves it up to
where the limit holds. The budget is the smallest at which every source is drawn whole at least once. A source's budget is
spent on permutations of its blocks: whole epochs first, then the first blocks of one more epoch, the last of these
in part. Every draw follows from hashes of seed, source, epoch, block and id, so that repeated runs agree.

Defined cases: null and empty sources count as one; null texts and texts without words hold no tokens, and are drawn
once with each whole epoch; rows that share an id are drawn together; sources without tokens are drawn once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.common import checkpointed, materialise, n_words

#: Points that one job tries: four bisection steps at once.
_POINTS = 15
#: Sources up to which their table is broadcast (rows of under 100 bytes and a name); beyond, each row's source is split in so many parts.
_MOST_SOURCES, _PARTS = 50_000, 64


def _h(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _bisect(shares: DataFrame, fits: str, low: float, high: float, raise_to_fit: bool) -> float:
    """The exponent at the edge of where ``fits``, an expression of a, holds: its largest such value or, with raise_to_fit, its smallest; a multiple of 1e-6 on the fitting side."""
    for _ in range(6):
        points = [low + (high - low) * i / (_POINTS + 1) for i in range(1, _POINTS + 1)]
        got = shares.agg(*[F.expr(fits.replace("{a}", repr(a))).alias(f"p{i}") for i, a in enumerate(points)]).first()
        good = [a for i, a in enumerate(points) if got[i]]
        bad = [a for i, a in enumerate(points) if not got[i]]
        if raise_to_fit:
            low, high = max([low, *bad]), min([high, *good])
        else:
            low, high = max([low, *good]), min([high, *bad])
    return -(-high * 1e6 // 1) / 1e6 if raise_to_fit else low * 1e6 // 1 / 1e6


def weights(sizes: DataFrame, entropy: float = 0.95, max_repeats: float = 4.0) -> DataFrame:
    """sizes: source, tokens. Adds ``alpha``, ``weight``, ``budget`` (tokens to draw), ``epochs`` (whole ones) and ``rest``. entropy: the target, as a share of the logarithm of the number of sources."""
    positive = sizes.where("tokens > 0")
    total = positive.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("top"), F.min("tokens").alias("least")).first()
    alpha = 1.0
    if total.n and total.n > 1:
        shares = checkpointed(positive.select((F.log(F.col("tokens") / F.lit(float(total.t)))).alias("lp")))
        z = "sum(exp({a} * lp))"
        h = f"(ln({z}) - {{a}} * sum(exp({{a}} * lp) * lp) / {z}) >= {entropy} * ln(count(*))"
        alpha = 1.0 if shares.agg(F.expr(h.replace("{a}", "1.0"))).first()[0] else _bisect(shares, h, 0.0, 1.0, False)
        repeats = f"exp((1 - {{a}}) * (max(lp) - min(lp))) <= {max_repeats}"
        if not shares.agg(F.expr(repeats.replace("{a}", repr(alpha)))).first()[0]:
            alpha = _bisect(shares, repeats, alpha, 1.0, True)
    t, top = float(total.t or 1), float(total.top or 1)
    raw = F.pow(F.col("tokens") / F.lit(t), F.lit(alpha))
    z = positive.agg(F.sum(raw)).first()[0]
    weighed = positive.withColumn("weight", raw / F.lit(z or 1.0))
    budget = F.greatest(F.round(F.col("tokens") * F.pow(F.lit(top) / F.col("tokens"), F.lit(1 - alpha))).cast("long"), F.col("tokens"))
    spent = weighed.select("source", "tokens", F.lit(alpha).alias("alpha"), F.round("weight", 9).alias("weight"), budget.alias("budget"))
    spent = spent.select("*", F.floor(F.col("budget") / F.col("tokens")).alias("epochs")).select("*", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"))
    none = sizes.where("tokens = 0").select("source", "tokens", F.lit(alpha).alias("alpha"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("epochs"), F.lit(0).cast("long").alias("rest"))
    return spent.unionByName(none)


class Mix:
    """The draws of one table. ``schedule``: a row for every block that an epoch draws, with its rank there; ``upto``: the last key drawn, where it is drawn in part."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 18, seed: int = 7) -> None:
        self.source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
        self.key = _h(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
        self.rows = materialise(df.select(F.col(id_col).alias("id"), self.source.alias("source"), n_words(F.col(text_col)).alias("tokens"), self.key.alias("key")), "tokens")
        sources = weights(self.rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy, max_repeats)
        self.sources = checkpointed(sources.withColumn("blocks", F.ceil(F.greatest("tokens", F.lit(1)) / block_tokens)))
        self.n_sources = self.sources.count()
        placed = self.placed(self.rows)
        sums = checkpointed(placed.groupBy("source", "block").agg(F.sum("tokens").alias("size")))
        spent = F.greatest("budget", F.lit(1))
        epochs = sums.join(self.sources.select("source", "epochs", "rest", F.col("tokens").alias("all"), spent.alias("spent")), "source").select("source", "block", "size", "rest", "all", "spent", F.col("epochs").alias("last"), F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int"))).alias("epoch"))
        order = Window.partitionBy("source", "epoch").orderBy("order", "block")
        ranked = epochs.withColumn("order", _h(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block")))
        ranked = ranked.select("*", F.row_number().over(order).alias("block_rank"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
        ranked = checkpointed(ranked.where((F.col("epoch") < F.col("last")) | (F.col("before") < F.col("rest"))))
        same = (F.col("source") == F.col("s")) & (F.col("block") == F.col("b"))
        edge = ranked.where((F.col("epoch") == F.col("last")) & (F.col("before") + F.col("size") > F.col("rest"))).select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("room"))
        filled = placed.join(edge, same).withColumn("sum", F.sum("tokens").over(Window.partitionBy("s", "b").orderBy("key"))).where("sum <= room")
        upto = edge.select("s", "b").join(filled.groupBy("s", "b").agg(F.max("key").alias("upto")), ["s", "b"], "left").select("s", "b", F.coalesce("upto", F.lit("")).alias("upto"))
        partly = ranked.join(upto, same & (F.col("epoch") == F.col("last")), "left")
        position = (F.col("epoch") * F.col("all") + F.col("before")) / F.col("spent")
        self.schedule = checkpointed(partly.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "block_rank", "upto", position.alias("position")))

    def placed(self, rows: DataFrame) -> DataFrame:
        """Adds each row's block within its source. A hot source is never dealt to one task: the table of sources is broadcast where it is small, else it is repeated for parts of a source."""
        block = F.pmod(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), F.col("blocks"))
        of = self.sources.select(F.col("source").alias("of"), "blocks")
        same = F.col("source") == F.col("of")
        if self.n_sources <= _MOST_SOURCES:
            return rows.join(F.broadcast(of), same).withColumn("block", block).drop("of", "blocks")
        parts = of.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
        split = rows.withColumn("part", F.pmod(F.crc32("key"), F.lit(_PARTS)).cast("int"))
        return split.join(parts, same & (F.col("part") == F.col("of_part"))).withColumn("block", block).drop("of", "blocks", "part", "of_part")

    def drawn(self, rows: DataFrame) -> DataFrame:
        """rows: with source and key. One row for each draw."""
        drawn = self.placed(rows).join(self.schedule, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
        return drawn.where(F.col("upto").isNull() | (F.col("key") <= F.col("upto"))).drop("s", "b", "upto")


def schedule(df: DataFrame) -> DataFrame:
    """Every draw of every document: doc_id, source, ``tokens``, ``epoch``, ``block`` and ``block_rank``, the block's place in its source's epoch. ``Mix.drawn`` gives ``position`` too."""
    mix = Mix(df)
    return mix.drawn(mix.rows).select(F.col("id").alias("doc_id"), "source", "tokens", "epoch", "block", "block_rank")


def mixed(df: DataFrame, order: bool = True, **settings: object) -> DataFrame:
    """All columns of the rows, each row as often as it is drawn. Rows lie in the order of the draws: by ``position`` - the share of its source's budget that is spent before a block - then by source, epoch and key, in
    ascending ranges over the partitions. So any stretch of what is written holds the sources in the proportions of their budgets, blocks in the order of their permutations, and draws of one row apart. Without ``order`` rows lie anywhere."""
    mix = Mix(df, **settings)
    drawn = mix.drawn(df.select(F.struct("*").alias("row"), mix.source.alias("source"), mix.key.alias("key")))
    if order:
        drawn = drawn.repartitionByRange("position", "source", "epoch", "key").sortWithinPartitions("position", "source", "epoch", "key")
    return drawn.select("row.*")
