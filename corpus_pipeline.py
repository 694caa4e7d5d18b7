"""A training-data pipeline: each stage works on all that the stage before it kept.

Every stage takes and returns the columns of ``documents``; the last returns token ids. Rows of nulls, empty texts,
repeated rows and empty tables follow the rules in the docstrings of the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import bpe, langid, mixing, nearcopies, simhash, substrings
from threadmill.llm.common import discard, materialise
from threadmill.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter go, and those whose score lies far below those of their language and length."""
    return langid.accept(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, and among what it leaves near copies by five-word shingles with a similarity of 0.8 or more: of each group the document with the smallest id stays."""
    return nearcopies.dedup(simhash.dedup(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages are cut out; documents of which nothing is left go."""
    cut = substrings.dedup(docs).where(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)
    return cut.select(*[F.length("text").cast(cut.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in cut.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: every document once for each time that the mixture draws it, at least once, in the order of the draws."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the token ids of every draw. Workers come from other stages with what they hold, and so remember fewer words."""
    return bpe.encode(docs, VOCABULARY, memo=32 << 20)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

#: The first stages learn a model and hash with XXH64, which SQL does not express; tests hold the near-duplicate stage against an exact search and later stages against plain versions, on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read back before the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
