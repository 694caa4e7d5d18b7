"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a new local one where that is unset and all tasks run in this process. Raises on a cluster that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="threadmill-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/threadmill/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def holds(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession) -> None:
    """Delete all that operators have left in the shared folder for this application; to be called when their results are written, as results that are still to be read come from there."""
    _delete(spark, _folder(spark))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.scratch_path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, as like the given ones as can be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def scratch_uri(spark: SparkSession, name: str) -> str:
    """The same as a URI of the file system that Spark takes for the path, for readers and writers in tasks that need the scheme. The stores of ``s3a`` are ``s3`` to them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark, name))
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if found.startswith("file:/") and not found.startswith("file:///"):
        found = f"file://{found.removeprefix('file:')}"
    return f"s3://{found.partition('://')[2]}" if found.startswith(("s3a://", "s3n://")) else found


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """Settings for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Lets Spark delete an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later uses neither recompute it nor depend on the executors that made it, and its shuffle files go at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a small result; Spark removes its files when nothing refers to it any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int) -> DataFrame:
    """A table that is written, counted, and broadcast where it has at most so many rows."""
    df = df if hasattr(df, "scratch_path") else materialise(df, "small")
    return F.broadcast(df) if df.count() <= most else df


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes in that column and so many rows; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to
