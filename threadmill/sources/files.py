"""Readers of captured files, logs and folders."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_records(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Records of whole-file JSON: bare arrays, or objects that hold the array under ``key``; bad files give no rows."""
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).json(path)
    return raw.select(F.explode(key).alias("r")).select("r.*") if key in raw.columns else raw


def known_ids(spark: SparkSession, path: str, key: str = "posts") -> DataFrame:
    """Distinct ids over all files of a glob."""
    return json_records(spark, path, key).select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()


def companies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each company and account of a configuration; of companies with one id the last counts, in the order of files' paths and of places in a file."""
    raw = spark.read.option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("companies").alias("at", "c"))
    last = F.row_number().over(Window.partitionBy("c.id").orderBy(F.desc("file"), F.desc("at")))
    kept = raw.withColumn("k", last).where("k = 1").select("c.*")
    return kept.select(F.col("id").alias("company_id"), F.col("name"), "industry", "country", F.explode("accounts").alias("a")).select("company_id", "name", "industry", "country", "a.*")


def checkpoint_ids(spark: SparkSession, path: str, key: str = "processed_post_ids") -> DataFrame:
    """Ids that a checkpoint file lists; none where it is missing or broken."""
    text = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path)
    return text.select(F.explode(F.from_json("value", f"{key} ARRAY<STRING>")[key]).alias("id")).distinct()


def journal(lines: DataFrame) -> DataFrame:
    """lines: value, line_no. The last action of every operation."""
    part = F.split("value", r"\|")
    rows = lines.select(F.get(part, 0).alias("action"), F.get(part, 1).alias("op_id"), "line_no").where("op_id is not null")
    return rows.groupBy("op_id").agg(F.max_by("action", "line_no").alias("action"))


def incomplete(lines: DataFrame) -> DataFrame:
    """Operations that began and neither ended nor were rolled back."""
    return journal(lines).where("action = 'START'").select("op_id")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime and length of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")


def exports(spark: SparkSession, base: str, client: str | None = None, platform: str | None = None, fmt: str | None = None) -> DataFrame:
    """Files below base/client/platform in any month, by client, platform and format where given, in the order of their paths."""
    files = listing(spark, base)
    parts = F.split(F.regexp_replace("path", rf"^.*?{re.escape(base.rstrip('/').removeprefix('file://'))}/", ""), "/")
    for at, wanted in ((0, client), (1, platform)):
        if wanted is not None:
            files = files.where(F.get(parts, at) == wanted.lower())
    return (files.where(F.endswith(F.lower("path"), F.lit(f".{fmt.lower()}"))) if fmt else files).orderBy("path")


def latest(files: DataFrame, by: str = "modificationTime", *keys: str) -> DataFrame:
    """The newest file of each key, by time or by name."""
    return files.groupBy(*keys).agg(F.max_by("path", by).alias("path") if by != "path" else F.max("path").alias("path"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of every file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"))
