"""JSON documents of any size: a Python data source whose tasks write fragments and whose commit puts head, rows and tail together.

Rows stay text from first to last and no row holds a document. A task writes one fragment for each of its partitions, or one file (and its copy) for each document where there are many; only the names of fragments reach the driver,
whose commit streams them into one file and moves that to its place, or moves the files of many documents. What a failed attempt or an aborted write has left goes with the folder of fragments.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, IntegralType, StringType

#: In a document's order; EMPTY is the whole of it where no row came.
HEAD, ROW, TAIL, EMPTY = 0, 1, 2, 3
_ROWS = "\x00rows\x00"


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    #: Of every fragment or file: where it lies, where it belongs (a file of one of many documents), and its rows.
    parts: list[tuple[str, str | None, int]]


class DocumentSource(DataSource):
    """Write-only. ``path`` names the file, or with ``many`` the folder below which column ``file`` names files. All options are text; the folder of fragments lies beside the path."""

    @classmethod
    def name(cls) -> str:
        return "threadmill_document"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def _joined(texts: pa.Array, between: str) -> pa.Buffer:
    """The texts as one, in UTF-8."""
    if texts.null_count:
        raise ValueError("a row without text")
    long = texts.cast(pa.large_string())
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(long)], pa.int64()), long), pa.scalar(between, pa.large_string()))[0].as_buffer()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options
        self.staging = f"{options['path']}.{options['run']}.parts"

    def _open(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        at = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        store, folder = self._open(at)
        store.create_dir(folder, recursive=True)
        return _Written(context.partitionId(), (self._many if "many" in self.o else self._one)(iterator, store, at, folder))

    def _one(self, batches: Iterator[pa.RecordBatch], store: fs.FileSystem, at: str, folder: str) -> list[tuple[str, str | None, int]]:
        between, n, out = self.o["between"], 0, None
        try:
            for batch in batches:
                if batch.num_rows:
                    out = out or store.open_output_stream(f"{folder}/0")
                    out.write(between.encode() if n else b"")
                    out.write(_joined(batch.column("value"), between))
                    n += batch.num_rows
        finally:
            if out:
                out.close()
        return [(f"{at}/0", None, n)] if n else []

    def _many(self, batches: Iterator[pa.RecordBatch], store: fs.FileSystem, at: str, folder: str) -> list[tuple[str, str | None, int]]:
        """A document's rows come between its head and its tail, a batch's share of them in one piece; rows that no head is before have no document."""
        between, parts, out, begin, n = self.o["between"], [], [], None, 0

        def put(text: pa.Buffer | bytes) -> None:
            for o in out:
                o.write(text)

        try:
            for batch in batches:
                file, copy, kinds, values = (batch.column(c) for c in ("file", "copy", "kind", "value"))
                edges = pc.indices_nonzero(pc.not_equal(kinds, ROW)).to_pylist()
                for first, last in zip([-1, *edges], [*edges, batch.num_rows]):
                    if begin is not None and last > first + 1:
                        put((between if n else begin).encode("utf-8"))
                        put(_joined(values[first + 1 : last], between))
                        n += last - first - 1
                    if last == batch.num_rows:
                        break
                    kind = kinds[last].as_py()
                    if kind == HEAD:
                        begin, n = values[last].as_py(), 0
                        for name in (copy[last].as_py(), file[last].as_py()):
                            if name:
                                out.append(store.open_output_stream(f"{folder}/{len(parts)}"))
                                parts.append((f"{at}/{len(parts)}", name, 0))
                    elif bool(n) == (kind == TAIL):
                        put(values[last].as_py().encode("utf-8"))
                    if kind == EMPTY:
                        begin = None
                        while out:
                            out.pop().close()
        finally:
            for o in out:
                o.close()
        return parts

    def commit(self, messages: list[_Written | None]) -> None:
        parts = [p for m in sorted((m for m in messages if m), key=lambda m: m.partition) for p in m.parts]
        store, staging = self._open(self.staging)
        store.create_dir(staging, recursive=True)
        if "many" in self.o:
            for at, name, _ in parts:
                self._place(store, self._open(at)[1], f"{self.o['path']}/{name}")
        else:
            whole, rows = f"{staging}/whole", sum(p[2] for p in parts)
            with store.open_output_stream(whole) as out:
                if not rows:
                    out.write(self.o["empty"].encode())
                else:
                    out.write(self.o["begin"].encode())
                    for k, part in enumerate(parts):
                        out.write(self.o["between"].encode() if k else b"")
                        self._copied(store, self._open(part[0])[1], out)
                    out.write(self.o["end"].encode())
            self._place(store, whole, self.o["path"])
        store.delete_dir(staging)

    def abort(self, messages: list[_Written | None]) -> None:
        """Tasks that still run when a write is aborted may write for a moment more: their folder goes until it stays away."""
        store, staging = self._open(self.staging)
        away = 0
        for _ in range(40):
            if store.get_file_info(staging).type != fs.FileType.NotFound:
                store.delete_dir(staging)
                away = 0
            away += 1
            if away > 4:
                break
            time.sleep(0.25)

    @staticmethod
    def _copied(store: fs.FileSystem, at: str, out: Any) -> None:
        with store.open_input_stream(at) as held:
            while piece := held.read(4 << 20):
                out.write(piece)

    def _place(self, store: fs.FileSystem, at: str, uri: str) -> None:
        """Move, so that a reader finds the old file or the new one."""
        _, target = self._open(uri)
        store.create_dir(target.rpartition("/")[0], recursive=True)
        if store.get_file_info(target).type == fs.FileType.Directory:
            store.delete_dir(target)
        store.move(at, target)


def _uri(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that it belongs to, as tasks that are not Spark's readers need it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.makeQualified(at).toString()
    return f"file://{found.removeprefix('file:')}" if found.startswith("file:/") and not found.startswith("file:///") else found


def _save(df: DataFrame, path: str, **options: str) -> None:
    spark = df.sparkSession
    spark.dataSource.register(DocumentSource)
    df.write.format("threadmill_document").mode("append").options(path=_uri(spark, path), run=uuid.uuid4().hex, **options).save()


def skeleton(head: dict | None, key: str, indent: int | None, sort_keys: bool = False, ensure_ascii: bool = False) -> dict[str, str]:
    """What stands before, between and behind the rows of a document that is head's entries and the list ``key``, or the list alone, and the document without rows."""
    dump = lambda rows: json.dumps(rows if head is None else head | {key: rows}, indent=indent, sort_keys=sort_keys, ensure_ascii=ensure_ascii)
    begin, _, end = dump([_ROWS]).partition(json.dumps(_ROWS))
    return {"begin": begin, "end": end, "between": ", " if indent is None else ",\n" + " " * level(head, indent), "empty": dump([])}


def level(head: dict | None, indent: int | None) -> int:
    """White space before a row."""
    return (indent or 0) * (1 if head is None else 2)


def dumped(df: DataFrame, indent: int | None = None, spaces: int = 0, sort_keys: bool = False, ensure_ascii: bool = False) -> DataFrame:
    """df: ``value``, a JSON text, and any other columns; the same with each text laid out anew: nested keys sorted, indented as part of a document, or in ASCII alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("value")
            texts = [x if x is None else json.dumps(json.loads(x), indent=indent, sort_keys=sort_keys, ensure_ascii=ensure_ascii).replace("\n", "\n" + " " * spaces) for x in batch.column(k).to_pylist()]
            yield batch.set_column(k, "value", pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def _quoted(text: Column) -> Column:
    """A string as json.dumps writes it."""
    named = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    escaped = text
    for char in [*named, *(c for c in map(chr, range(32)) if c not in named)]:
        escaped = F.replace(escaped, F.lit(char), F.lit(named.get(char, f"\\u{ord(char):04x}")))
    return F.concat(F.lit('"'), F.when(text.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(text), F.lit('"'))


def objects(df: DataFrame, file: Column, columns: list[str], order: list[str], indent: int, spaces: int) -> DataFrame:
    """``file``, ``value``, a JSON object of the columns, laid out as ``dumped`` does, and the columns of the order under other names. Where all are strings, whole numbers or truth values, the text is put together in columns; else ``dumped`` lays it out."""
    types = [df.schema[c].dataType for c in columns]
    made = lambda value: df.select(file.alias("file"), value.alias("value"), *[F.col(c).alias(f"order{k}") for k, c in enumerate(order)])
    if not columns or not all(t == StringType() or isinstance(t, (IntegralType, BooleanType)) for t in types):
        return dumped(made(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), indent, spaces)
    line = "\n" + " " * (indent + spaces)
    pieces = []
    for k, (c, t) in enumerate(zip(columns, types)):
        pieces += [F.lit(f"{',' if k else '{'}{line}{json.dumps(c, ensure_ascii=False)}: "), F.coalesce(_quoted(F.col(c)) if t == StringType() else F.col(c).cast("string"), F.lit("null"))]
    return made(F.concat(*pieces, F.lit("\n" + " " * spaces + "}")))


def write_document(rows: DataFrame, path: str, head: dict | None, key: str, indent: int | None = 2, sort_keys: bool = False, ensure_ascii: bool = False) -> None:
    """One file. rows: ``value``, JSON objects as text, in the order of their partitions."""
    laid = dumped(rows.select("value"), indent, level(head, indent), sort_keys, ensure_ascii)
    _save(laid, path, **skeleton(head, key, indent, sort_keys, ensure_ascii))


def write_documents(heads: DataFrame, rows: DataFrame, base: str, key: str, indent: int | None = 2) -> None:
    """A file for each of many documents. heads: ``file``, ``head`` (its entries as a JSON object) and ``copy``, a second file or null; rows: of ``objects``, whose further columns give the order. A document is written by one task, as a stream; ``write_document`` shares one out. Rows without a head are left out, as no document has them."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, head, copy = (batch.column(c).to_pylist() for c in ("file", "head", "copy"))
            layouts = [skeleton(json.loads(text), key, indent) for text in head]
            thrice = lambda xs: [x for x in xs for _ in range(3)]
            values = [s[x] for s in layouts for x in ("begin", "end", "empty")]
            yield pa.RecordBatch.from_arrays([pa.array(thrice(file), pa.string()), pa.array(thrice(copy), pa.string()), pa.array([HEAD, TAIL, EMPTY] * len(file), pa.int32()), pa.array(values, pa.string())], ["file", "copy", "kind", "value"])

    frames = heads.select("file", "head", "copy").mapInArrow(framed, "file string, copy string, kind int, value string")
    every = frames.unionByName(rows.withColumn("kind", F.lit(ROW)), allowMissingColumns=True)
    _save(every.repartition("file").sortWithinPartitions("file", "kind", *rows.columns[2:]).select("file", "copy", "kind", "value"), base, many="true", between=skeleton({}, key, indent)["between"])


def account_files(documents: DataFrame, comments: DataFrame, key: str, base: str, day: Column, order: list[str]) -> None:
    """Of each account with comments the file ``<account>/<day>.json`` with head, statistics and comments, and its copy ``latest.json``. documents: of ``results.account_document``, with ``platform`` and ``extracted_at``; comments: with the key."""
    stats = F.struct("top_level_comments", "replies", "expected_comments", "extraction_ratio").alias("stats")
    meta = F.struct("version", F.lit("full").alias("extraction_type"), "posts_processed", F.lit(True).alias("is_complete")).alias("meta")
    account = F.col(key).cast("string")
    head = F.to_json(F.struct(meta, account.alias("account_id"), "platform", "extracted_at", F.col("posts_processed").alias("total_posts_processed"), "total_comments", stats), {"ignoreNullFields": "false"})
    file = F.concat(account, F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit(".json"))
    heads = documents.where("total_comments > 0").select(file.alias("file"), head.alias("head"), F.concat(account, F.lit("/latest.json")).alias("copy"))
    own = [c for c in comments.columns if c != key]
    write_documents(heads, objects(comments, file, own, order, 2, level({}, 2)), base, "comments")


def company_files(rows: DataFrame, keys: tuple[str, str, str], kind: str, base: str, at: Column, order: list[str]) -> None:
    """Of each company, platform and account the file ``<company>/<platform>/<account>_<kind>_<time>.json`` with ``metadata`` and its rows. rows: with the three keys; ``kind`` is posts or comments."""
    company, platform, account = (F.col(k).cast("string") for k in keys)
    file = F.concat(F.concat_ws("/", company, platform, account), F.lit(f"_{kind}_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit(".json"))
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    meta = F.struct(company.alias("company_id"), platform.alias("platform"), account.alias("account"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("extracted_at"), F.col("n").alias(f"total_{kind}"))
    heads = counted.select(file.alias("file"), F.to_json(F.struct(meta.alias("metadata"))).alias("head"), F.lit(None).cast("string").alias("copy"))
    own = [c for c in rows.columns if c not in keys]
    write_documents(heads, objects(rows, file, own, order, 2, level({}, 2)), base, kind)
