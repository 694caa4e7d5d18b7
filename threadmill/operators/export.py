"""Export options, projections and writers."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions.dates import formatted
from threadmill.functions.safety import within
from threadmill.functions.text import truncate
from threadmill.operators import documents
from threadmill.session import written


@dataclass(frozen=True)
class Options:
    """What an export holds, and how it is written."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    date_style: str = "iso"
    date_pattern: str | None = None
    zone: str | None = None
    flatten_author: bool = False
    keep_empty: bool = True
    max_text: int | None = None
    metadata: bool = True
    #: Of JSON lines: a first line of metadata, and the kind of record in each line.
    metadata_line: bool = True
    type_field: bool = True
    stats: bool = False
    indent: int | None = 2
    sort_keys: bool = False
    delimiter: str = ","
    quote_all: bool = False
    ensure_ascii: bool = False
    quoting: int = 0
    header: bool = True
    line_end: str = "\n"
    #: What the metadata name, and whether the rows are comments or posts.
    client: str = ""
    exported_at: str = ""
    key: str = "comments"


#: The presets' settings.
PRESETS: dict[str, Options] = {
    "minimal": Options(include=("id", "platform", "text", "author_username", "published_at", "likes"), flatten_author=True, metadata=False, indent=None),
    "analytics": Options(date_style="timestamp", flatten_author=True, stats=True, sort_keys=True),
    "readable": Options(date_style="human", indent=4, stats=True),
    "streaming": Options(indent=None, metadata_line=False, keep_empty=False),
    "excel_friendly": Options(quote_all=True, date_style="iso_date", flatten_author=True),
}


def preset(name: str, **changes: object) -> Options:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return replace(PRESETS[name], **changes)


def project(df: DataFrame, o: Options) -> DataFrame:
    """Dates as text, author flattened, fields chosen in the source's order, then renamed; of columns that get one name the later wins."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            df = df.withColumn(f.name, formatted(F.col(f.name), o.date_style, o.date_pattern, o.zone))
    if o.max_text and "text" in df.columns:
        df = df.withColumn("text", truncate(F.col("text"), o.max_text))
    if o.flatten_author and "author" in df.columns:
        inner = df.schema["author"].dataType.names
        df = df.select(*[c for c in df.columns if c != "author"], *[F.col(f"author.{n}").alias(f"author_{'id' if n == 'platform_id' else n}") for n in inner])
    names = [c for c in df.columns if (not o.include or c in o.include) and c not in o.exclude]
    final = {o.rename.get(c, c): c for c in names}
    return df.select(*[F.col(c).alias(n) for n, c in final.items()])


def _without_empty(df: DataFrame) -> list[Column]:
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.StringType):
            return F.nullif(F.col(f.name), F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name)
        return F.col(f.name)

    return [one(f) for f in df.schema.fields]


def _json_value(d: DataFrame, o: Options, kind: str | None) -> Column:
    cols = _without_empty(d) if not o.keep_empty else [F.col(c) for c in d.columns]
    if o.sort_keys:
        cols = [c for _, c in sorted(zip(d.columns, cols), key=lambda x: x[0])]
    tag = [F.lit(kind).alias("type")] if kind else []
    return F.to_json(F.struct(*tag, *cols), {"ignoreNullFields": str(not o.keep_empty).lower()}).alias("value")


def json_lines(df: DataFrame, o: Options, kind: str | None = None) -> DataFrame:
    """One object per row as ``value``; a type tag comes first. Without empty fields, nulls, empty strings and arrays are left out."""
    d = project(df, o)
    return d.select(_json_value(d, o, kind))


#: Version of the documents' layout.
VERSION = "1.0"


def statistics(df: DataFrame) -> DataFrame:
    """Rows, platforms, mean likes, and of replies, comments and shares the sums of those columns that there are; 0 without rows."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("replies_count", "total_replies"), ("comments_count", "total_comments"), ("shares", "total_shares")) if c in df.columns]
    return df.agg(F.count("*").alias("total"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.coalesce(F.avg("likes"), F.lit(0.0)).alias("avg_likes"), *sums)


def ascii_only(json: Column) -> Column:
    """JSON text with everything beyond ASCII as escapes of UTF-16 units."""
    def unit(c: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(c)), 4, "0"))

    def escaped(x: Column) -> Column:
        code = F.conv(F.right(F.hex(F.encode(x, "UTF-32")), F.lit(8)), 16, 10).cast("long")
        low = code - 0x10000
        return F.when(code < 128, x).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(F.shiftright(low, 10) + 0xD800), unit(low.bitwiseAND(0x3FF) + 0xDC00)))

    return F.when(json.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(json, ""), escaped), "")).otherwise(json)


def document_metadata(df: DataFrame, o: Options, client: str, exported_at: Column, key: str = "comments", fmt: str = "json") -> DataFrame:
    """The head of a document as a struct ``metadata``: client, time, format, version, total, platforms and, where asked, statistics."""
    s = statistics(df)
    stats = [F.struct("avg_likes", *[c for c in s.columns if c.startswith("total_")]).alias("stats")] if o.stats else []
    head = [F.lit(client).alias("client"), exported_at.alias("exported_at"), F.lit(fmt).alias("format"), F.lit(VERSION).alias("version"), F.col("total").alias(f"total_{key}"), F.col("platforms"), *stats]
    if o.sort_keys:
        names = ["client", "exported_at", "format", "version", f"total_{key}", "platforms", *(["stats"] if o.stats else [])]
        head = [c for _, c in sorted(zip(names, head), key=lambda x: x[0])]
    return s.select(F.struct(*head).alias("metadata"))


def json_document(df: DataFrame, o: Options, client: str, exported_at: Column, key: str = "comments") -> DataFrame:
    """One document with metadata. For small exports alone: it is one row. Large ones write ``json_lines`` and the metadata beside them."""
    d = project(df, o)
    d = d.select(*sorted(d.columns)) if o.sort_keys else d
    body = d.agg(F.collect_list(F.struct("*")).alias(key))
    if not o.metadata:
        value = F.to_json(key, {"ignoreNullFields": "false"})
        return body.select((ascii_only(value) if o.ensure_ascii else value).alias("value"))
    names = sorted(["metadata", key]) if o.sort_keys else ["metadata", key]
    value = F.to_json(F.struct(*names), {"pretty": str(o.indent is not None).lower(), "ignoreNullFields": "false"})
    return document_metadata(df, o, client, exported_at, key).join(body).select((ascii_only(value) if o.ensure_ascii else value).alias("value"))


def metadata_line(df: DataFrame, client: str, exported_at: Column, key: str = "comments") -> DataFrame:
    """The first line of an export of JSON lines, as ``value``; written as a file of its own that sorts before the rows'."""
    n = df.agg(F.count("*").alias(f"total_{key}"))
    return n.select(F.to_json(F.struct(F.lit("metadata").alias("type"), F.lit(client).alias("client"), exported_at.alias("exported_at"), F.lit("jsonl").alias("format"), F.lit(VERSION).alias("version"), f"total_{key}")).alias("value"))


def _csv_value(d: DataFrame, o: Options) -> Column:
    special = "|".join([re.escape(o.delimiter), '"', "\r", "\n"])

    def one(f: T.StructField) -> Column:
        text = F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        needs = text.rlike(special)
        if o.quoting == 1 or (o.quoting == 2 and not isinstance(f.dataType, T.NumericType)):
            return quoted
        if o.quoting == 3:
            return F.when(needs, F.raise_error(F.lit(f"{f.name} needs quoting"))).otherwise(text)
        return F.when(needs, quoted).otherwise(text)

    return F.concat_ws(o.delimiter, *[one(f) for f in d.schema.fields]).alias("value")


def csv_lines(df: DataFrame, o: Options) -> DataFrame:
    """One line per row as ``value``. quoting: 0 where a field needs it, 1 all fields, 2 all but numbers, 3 none (a field that needs it raises). Nulls are empty fields; nested ones are JSON."""
    d = _flat(project(df, o))
    return d.select(_csv_value(d, o))


def _csv_head(names: list[str], o: Options) -> str:
    made = io.StringIO()
    csv.writer(made, delimiter=o.delimiter, quoting=o.quoting, lineterminator="").writerow(names)
    return made.getvalue()


def path_parts(client: Column, platform: Column, at: Column) -> Column:
    """client/platform/yyyy-MM."""
    return F.concat_ws("/", F.lower(client), F.lower(platform), F.date_format(at, "yyyy-MM"))


def file_name(client: Column, platforms: Column, kind: Column, at: Column, suffix: Column) -> Column:
    """client_platform_type_date_time.suffix; several platforms are sorted and joined, none gives all."""
    joined = F.array_join(F.array_sort(F.transform(platforms, lambda p: F.lower(p))), "_")
    return F.concat(F.concat_ws("_", F.lower(client), F.when(joined == "", "all").otherwise(joined), kind, F.date_format(at, "yyyyMMdd_HHmmss")), F.lit("."), suffix)


def beyond_newest(files: DataFrame, keep: int) -> DataFrame:
    """Files that a retention of the newest ``keep`` of each type removes. files: path, modificationTime. The type is the last but one token of the name - the date's, where the time has a token of its own."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    token = F.get(F.reverse(F.split(stem, "_")), 1)
    k = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("modificationTime"), "path"))
    return files.withColumn("type", token).withColumn("k", k).where(F.col("k") > keep).drop("k")


def older_than(files: DataFrame, now: Column, days: int) -> DataFrame:
    return files.where(F.unix_timestamp("modificationTime") < F.unix_timestamp(now) - days * 86400)


def batches(df: DataFrame, order: list[str], size: int, rows_each: int = 200_000) -> DataFrame:
    """Adds ``batch`` from 1, by global row numbers: rows are dealt in ranges of the whole order, and of their number in the input where that leaves ties, sorted and written with their place; the rows of the ranges before a row
    and that place make its number. So no task sees all rows, and neither a frequent first value nor long equal beginnings of strings put rows in one range."""
    ranges = max(1, -(-df.count() // rows_each))
    tied = df.withColumn("__t", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *order, "__t").sortWithinPartitions(*order, "__t").drop("__t")
    placed = written(dealt.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "batches")
    counts = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(before), "__p").withColumn("batch", F.ceil((F.col("__base") + F.col("__k") + 1) / size)).drop("__p", "__k", "__base")


def column_widths(df: DataFrame) -> DataFrame:
    """Sheet column widths: longest value and two more, from 10 to 50."""
    longest = lambda c: F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)))
    return df.agg(*[F.least(F.lit(50), F.greatest(F.lit(10), longest(c) + 2)).alias(c) for c in df.columns])


def _flat(df: DataFrame) -> DataFrame:
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    return df.select(*[F.col(c) if c in simple else F.to_json(c).alias(c) for c in df.columns])


def _write_csv(df: DataFrame, path: str, o: Options) -> None:
    """Lines, and before those of each file the header."""
    o = replace(o, quoting=1) if o.quote_all else o
    head = _csv_head(project(df, o).columns, o)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [head]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(first + batch.column(0).to_pylist(), pa.string())], ["value"])
                first = []

    lines = csv_lines(df, o)
    (lines.mapInArrow(headed, "value string") if o.header else lines).write.mode("overwrite").option("lineSep", o.line_end).text(path)


def _write_lines(df: DataFrame, path: str, o: Options) -> None:
    """JSON lines; the metadata are the first line of the first file. Keys keep their order, whatever the options say."""
    lines = json_lines(df, replace(o, sort_keys=False), o.key.removesuffix("s") if o.type_field else None)
    lines = documents.dumped(lines, ensure_ascii=True) if o.ensure_ascii else lines
    if o.metadata_line:
        lines = metadata_line(df, o.client, F.lit(o.exported_at), o.key).coalesce(1).unionByName(lines)
    lines.write.mode("overwrite").text(path)


def _write_json(df: DataFrame, path: str, o: Options) -> None:
    """One file, whatever its size, with metadata and statistics where asked."""
    head = None
    if o.metadata:
        head = json.loads(document_metadata(df, replace(o, sort_keys=False), o.client, F.lit(o.exported_at), o.key).select(F.to_json("metadata").alias("value")).first().value)
        head = {"metadata": head}
    documents.write_document(json_lines(df, o), path, head, o.key, o.indent, o.sort_keys, o.ensure_ascii)


WRITERS: dict[str, Callable[[DataFrame, str, Options], None]] = {
    "jsonl": _write_lines,
    "json": _write_json,
    "csv": _write_csv,
    "parquet": lambda df, path, o: project(df, o).write.mode("overwrite").parquet(path, compression="snappy"),
}


def write(df: DataFrame, fmt: str, base: str, *parts: str, options: Options | None = None) -> str:
    """Write below ``base`` in a registered format, whatever its case."""
    if fmt.lower() not in WRITERS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(sorted(WRITERS))}")
    path = within(base, *parts)
    WRITERS[fmt.lower()](df, path, options or Options())
    return path


def write_by(df: DataFrame, fmt: str, base: str, keys: list[str], options: Options | None = None, tasks_each: int = 8) -> None:
    """One write of all rows as JSON lines, CSV or Parquet, into a folder for each value of the keys. The rows of a value are dealt to some ``tasks_each`` tasks, so that a frequent one is several files; each CSV file begins with its header."""
    o, own = options or Options(), [f"__{k}" for k in keys]
    o = replace(o, quoting=1) if o.quote_all else o
    p = project(df.withColumns({f"__{k}": F.col(k).cast("string") for k in keys}), replace(o, include=(*o.include, *own) if o.include else ()))
    p = _flat(p) if fmt.lower() == "csv" else p
    body = p.select(*[c for c in p.columns if c not in own])
    if fmt.lower() not in ("csv", "jsonl", "parquet"):
        raise ValueError(f"one write to many folders takes csv, jsonl or parquet, not {fmt!r}")
    if fmt.lower() == "parquet":
        rows = p.select(*[c for c in body.columns if c not in keys], *own)
    else:
        rows = p.select(_csv_value(body, o) if fmt.lower() == "csv" else _json_value(body, replace(o, sort_keys=False), o.key.removesuffix("s") if o.type_field else None), *own)
    rows = rows.repartition(*own, F.pmod(F.xxhash64(*[c for c in rows.columns if c not in own]), F.lit(tasks_each))).sortWithinPartitions(*own)
    if fmt.lower() == "csv" and o.header:
        head = _csv_head(body.columns, o)

        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last: tuple | None = None
            for batch in batches:
                columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
                out: list[tuple] = []
                for row in zip(*columns):
                    if row[1:] != last:
                        last = row[1:]
                        out.append((head, *last))
                    out.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], batch.schema.names)

        rows = rows.mapInArrow(headed, rows.schema)
    for k, name in zip(keys, own):
        rows = rows.withColumnRenamed(name, k)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*keys)
    writer.parquet(base) if fmt.lower() == "parquet" else writer.option("lineSep", o.line_end).text(base)


def register(fmt: str, writer: Callable[[DataFrame, str, Options], None]) -> None:
    WRITERS[fmt.lower()] = writer
