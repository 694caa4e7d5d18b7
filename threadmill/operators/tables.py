"""Tables that change in one step: versions in folders of their own, a manifest that a rename switches, and a journal by which a broken write is undone.

    path/versions/<operation>/   the rows of one write
    path/current                 the manifest: which version holds, its rows and digest
    path/journal/                a file a line: START, COMMIT and ROLLBACK

A write notes START, writes its version, reads it back, switches the manifest and notes COMMIT. Readers follow the manifest, so they see the old rows or the new ones whatever
step a write dies at. ``recover`` closes what died: an operation that the manifest names gets its COMMIT, any other is rolled back and its folder deleted.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadmill.sources import files


def digest(df: DataFrame) -> list:
    """Row count and a sum of 64-bit row hashes, which does not depend on the order of rows, as columns of an aggregate."""
    names = sorted(df.columns)
    row = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    return [F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(20)")), F.lit(0).cast("decimal(30)")).cast("string").alias("digest")]


class VersionedTable:
    """One table below ``path``. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, on_step: Callable[[str], None] = lambda step: None) -> None:
        self.spark, self.path, self.on_step = spark, path.rstrip("/"), on_step
        self._jvm = spark.sparkContext._jvm
        self._files = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _put(self, path: str, text: str) -> None:
        out = self._files.create(self._at(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _note(self, action: str, operation: str, *rest: str) -> None:
        """A line in a file of its own: created under another name and renamed, so that no half line is read."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self._put(f"{self.path}/journal/.{name}", "|".join([action, operation, *rest]))
        if not self._files.rename(self._at(f"{self.path}/journal/.{name}"), self._at(f"{self.path}/journal/{name}")):
            raise OSError(f"no line could be added to the journal of {self.path}")

    def current(self) -> dict | None:
        """The manifest: version, rows, digest and schema; None before the first write."""
        if not self._files.exists(self._at(f"{self.path}/current")):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/current", wholetext=True).first().value)

    def read(self) -> DataFrame:
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"nothing was written to {self.path}")
        return self.spark.read.schema(now["schema"]).parquet(f"{self.path}/versions/{now['version']}")

    def write(self, df: DataFrame) -> str:
        """Replace the rows; returns the digest. Rows are counted and hashed while they are written, and again when they are read back; a difference raises before anything is switched."""
        operation = uuid.uuid4().hex
        at = f"{self.path}/versions/{operation}"
        self._note("START", operation, time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime()))
        self.on_step("started")
        seen = Observation()
        df.observe(seen, *digest(df)).write.parquet(at)
        self.on_step("written")
        back = self.spark.read.schema(df.schema).parquet(at)
        found = back.agg(*digest(back)).first().asDict()
        if found != seen.get:
            self._drop(at)
            self._note("ROLLBACK", operation, "digest")
            raise OSError(f"{at} does not hold what was written: {found}, not {seen.get}")
        self.on_step("verified")
        self._switch({"version": operation, "schema": df._jdf.schema().toDDL(), **found})
        self.on_step("switched")
        self._note("COMMIT", operation, found["digest"], at)
        self.on_step("committed")
        return found["digest"]

    def _switch(self, manifest: dict) -> None:
        self._put(f"{self.path}/.current", json.dumps(manifest))
        self.on_step("prepared")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._files.makeQualified(self._at(f"{self.path}/.current")), self._files.makeQualified(self._at(f"{self.path}/current")), rename)

    def _drop(self, path: str) -> None:
        self._files.delete(self._at(path), True)

    def journal(self) -> DataFrame:
        """``value`` and ``line_no``, in the order in which lines were added."""
        at = f"{self.path}/journal"
        if not self._files.exists(self._at(at)):
            return self.spark.createDataFrame([], "value string, line_no string")
        return self.spark.read.text(at, wholetext=True, pathGlobFilter="[0-9]*").select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("line_no"))

    def recover(self) -> dict[str, str]:
        """Close every open operation; what became of each, by operation."""
        now, done = self.current(), {}
        for row in files.incomplete(self.journal()).toLocalIterator():
            if now and row.op_id == now["version"]:
                self._note("COMMIT", row.op_id, now["digest"], f"{self.path}/versions/{row.op_id}")
                done[row.op_id] = "committed"
            else:
                self._drop(f"{self.path}/versions/{row.op_id}")
                self._note("ROLLBACK", row.op_id, "recovered")
                done[row.op_id] = "rolled back"
        self._drop(f"{self.path}/.current")
        return done

    def verify(self) -> bool:
        """Whether the current rows still have the manifest's digest."""
        now, back = self.current(), self.read()
        return back.agg(*digest(back)).first().asDict() == {k: now[k] for k in ("rows", "digest")}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions that committed but are not among the ``keep`` newest, the current one aside; for when no reader is left."""
        committed = self.journal().where(F.startswith("value", F.lit("COMMIT|"))).select(F.split("value", r"\|")[1].alias("op"), "line_no").orderBy(F.desc("line_no"))
        old = [r.op for r in committed.toLocalIterator() if r.op != (self.current() or {}).get("version")][max(keep - 1, 0) :]
        gone = [op for op in old if self._files.exists(self._at(f"{self.path}/versions/{op}"))]
        for op in gone:
            self._drop(f"{self.path}/versions/{op}")
        return gone
