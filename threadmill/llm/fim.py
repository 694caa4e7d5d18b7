"""Fill-in-middle: a document's prefix, suffix and middle in another order, cut between units.

A unit is a run of ASCII letters or any other single code point. Units are rows: ``posexplode`` of a text's matches, a window's running sum
of their lengths, and a join with the cut requests by the number of the unit that a cut follows. An aggregate per document turns
the two offsets that were asked for into one row, and ``substring`` cuts the text.

The cuts, the form and so the output depend on id and text alone. So units are laid out once for each distinct pair of them, under a 128-bit key: rows
that are repeated, however often, add none, and a window holds the units of one text. Texts go over the network twice, units never: the window, the join and
the aggregate all stand on the partitioning by key. Offsets are written to the shared folder.

Defined cases: a null text is empty and so plain; a null id counts as the empty string in the hash that draws the cuts; repeated rows give
repeated results; an empty table gives an empty result; extra input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.llm.common import discard, materialise, settings

#: What a unit is, and the marks of the parts.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a text may be joined, summed and windowed where they are: a partitioning by key serves a join by key and ordinal.
_PART_OF_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Bytes of text whose units one task sorts, and tasks at most; with more text, sorts spill.
TEXT_BYTES, MOST_TASKS = 4 << 20, 100_000


def _draw(k: int) -> Column:
    """The k-th group of eight digits of the row's digest."""
    return F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (not null) and the key ``k1``, ``k2``."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64(F.col("id").cast("string")).alias("k1"), F.xxhash64("text").alias("k2"))


def requests(rows: DataFrame, plain_percent: int, spm_percent: int) -> DataFrame:
    """Of every key ``n``, ``form``, and the units before the two cuts, ``first`` and ``second``."""
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    rows = rows.withColumn("n", F.length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | marked | (_draw(3) % 100 >= plain_percent)
    a, b = _draw(1) % (F.col("n") + 1), _draw(2) % (F.col("n") + 1)
    return rows.select("k1", "k2", "n", F.when(plain, "plain").when(_draw(4) % 100 < spm_percent, "spm").otherwise("psm").alias("form"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).distinct()


def offsets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The code points before either cut, ``first_at`` and ``second_at``, of every key with a cut behind its first unit."""
    texts = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    units = texts.select("k1", "k2", F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("at", "unit")).selectExpr("k1", "k2", "at", "length(unit) as size")
    ends = units.selectExpr("k1", "k2", "at", "sum(size) over (partition by k1, k2 order by at rows unbounded preceding) as end")
    cuts = asked.where("form <> 'plain'").selectExpr("k1 as j1", "k2 as j2", "explode(array(struct(1 as which, first as after), struct(2 as which, second as after))) as cut").where("cut.after > 0").selectExpr("j1", "j2", "cast(cut.after - 1 as int) as last", "cut.which as which")
    met = ends.join(cuts, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & (F.col("at") == F.col("last")))
    return met.groupBy("k1", "k2").agg(F.max(F.when(F.col("which") == 1, F.col("end"))).alias("first_at"), F.max(F.when(F.col("which") == 2, F.col("end"))).alias("second_at"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. No mark occurs in the parts, and none can arise where two parts meet, as a mark's ``<`` is its first character alone."""

    def between(low: str, high: str | None) -> Column:
        upto = F.substring_index(output, high, 1) if high else output
        return F.substring_index(upto, low, -1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``."""
    spark, rows = df.sparkSession, _rows(df, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // TEXT_BYTES + 1, MOST_TASKS))
    asked = materialise(requests(rows, plain_percent, spm_percent), "requests")
    with settings(spark, {_PART_OF_KEYS: "false", "spark.sql.shuffle.partitions": tasks, "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        at = materialise(offsets(rows, asked), "offsets")
    found = materialise(asked.join(at, ["k1", "k2"], "left").selectExpr("k1", "k2", "n", "form", "cast(coalesce(first_at, 0) as int) as p", "cast(coalesce(second_at, 0) as int) as q"), "cuts")
    discard(asked, at)
    cut = rows.join(found, ["k1", "k2"])
    prefix, middle, suffix = F.expr("substring(text, 1, p)"), F.expr("substring(text, p + 1, q - p)"), F.expr("substring(text, q + 1)")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    shown = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return cut.select(F.col("id").alias(id_col), "n", "form", shown(F.col("p")).alias("prefix_chars"), shown(F.col("q") - F.col("p")).alias("middle_chars"), output.alias("output"))


def digests(df: DataFrame) -> DataFrame:
    out = transform(df)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
