"""Full-text search by stems over a persisted index.

The index holds each stem of each row once, with how often it occurs, in folders by a hash of the stem and within those in the order of stems. A search reads the folders of its own stems alone,
and of their files the row groups that may hold them. Texts are read when the index is built, never when it is searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions.stems import stem

WORD = r"[\p{L}\p{N}]+"


def _each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and ``word`` (in lower case), as often as the row has it."""
    return df.select(F.col(id_col), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD), F.lit(0))).alias("word"))


def words(df: DataFrame, id_col: str = "seq", text_col: str = "text") -> DataFrame:
    """The id, ``word`` (in lower case) and ``n``, how often the row has it. Null texts have no words."""
    return _each(df, id_col, text_col).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def vocabulary(found: DataFrame) -> DataFrame:
    """Every distinct word and its ``stem``: words are stemmed once, whatever the number of rows that have them."""
    return found.select("word").distinct().withColumn("stem", stem(F.col("word")))


def _stems(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and ``stem``, as often as the row has it. Words are shuffled once, held against a table of the distinct ones; counting them first would cost more than it saves."""
    each = _each(df, id_col, text_col)
    return each.join(vocabulary(each).hint("shuffle_hash"), "word").select(id_col, "stem")


def index(df: DataFrame, id_col: str = "seq", text_col: str = "text") -> DataFrame:
    """``stem``, the id and ``n``."""
    return _stems(df, id_col, text_col).groupBy("stem", id_col).agg(F.count("*").alias("n"))


def _bucket(s: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(s), F.lit(buckets)).cast("int")


def _dealt(df: DataFrame, buckets: int, id_col: str, text_col: str, files: int) -> DataFrame:
    """The index's rows with ``bucket``, dealt to tasks and in order. Stems are counted where they are dealt, not in a shuffle of their own."""
    each = _stems(df, id_col, text_col).withColumns({"bucket": _bucket(F.col("stem"), buckets), "__deal": F.pmod(F.xxhash64(id_col), F.lit(files))})
    rows = each.repartition("bucket", "__deal").groupBy("bucket", "__deal", "stem", id_col).agg(F.count("*").alias("n")).drop("__deal")
    return rows.sortWithinPartitions("bucket", "stem", id_col)


def build(df: DataFrame, path: str, buckets: int = 64, id_col: str = "seq", text_col: str = "text", files: int = 8) -> None:
    """Write the index below ``path``. A bucket is dealt to some ``files`` tasks by the hash of the id, so that a frequent stem is in several files."""
    _dealt(df, buckets, id_col, text_col, files).write.mode("overwrite").partitionBy("bucket").parquet(path)
    df.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_settings")


def hits(spark: SparkSession, path: str, query: list[str]) -> DataFrame:
    """The index rows of the query's stems."""
    buckets = spark.read.json(f"{path}/_settings", schema="buckets int").first().buckets
    wanted = spark.createDataFrame([(w,) for w in query], "word string").select(stem(F.col("word")).alias("stem")).distinct().withColumn("bucket", _bucket(F.col("stem"), buckets)).collect()
    kept = spark.read.parquet(path).where(F.col("bucket").isin(sorted({r.bucket for r in wanted})) & F.col("stem").isin([r.stem for r in wanted]))
    return kept.withColumn("wanted", F.lit(len(wanted)))


def search(spark: SparkSession, path: str, query: list[str], every: bool = True, id_col: str = "seq") -> DataFrame:
    """Ids of rows that have all the query's stems, or any of them, and ``score``, how often."""
    found = hits(spark, path, query).groupBy(id_col, "wanted").agg(F.count("*").alias("stems"), F.sum("n").alias("score"))
    return (found.where("stems = wanted") if every else found).select(id_col, "score")
