"""Files that exports write, held against Python's own writers."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from threadmill.operators import documents, export, results

ROWS = [("a", "x", '  she said "no", twice  ', 2, 1, None), ("b", "y", None, 4, 0, "2024-03-01 10:00:00"), ("c", "x", "línea\nuno; 漢😀", 0, 5, "2024-03-02 00:00:00"), ("d", "x", "", 7, 0, None)]


def frame(spark, parts=3):
    df = spark.createDataFrame(ROWS, "id string, platform string, text string, likes long, replies_count long, at string").withColumn("published_at", F.col("at").cast("timestamp")).drop("at")
    df = df.withColumn("author", F.struct(F.concat(F.lit("u"), "id").alias("username"), F.lit("Z").alias("name")))
    return df.repartitionByRange(parts, "id").sortWithinPartitions("id")


def plain(df, o):
    """Rows as dictionaries, by the options."""
    out = [r.asDict(True) for r in export.project(df, o).collect()]
    return out if o.keep_empty else [{k: v for k, v in r.items() if v not in (None, "", [])} for r in out]


def read(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("name", [*export.PRESETS, "ascii"])
def test_json_file_is_what_json_dump_writes(spark, tmp_path, name):
    o = export.preset(name, client="c", exported_at="now") if name in export.PRESETS else export.Options(client="c", exported_at="now", ensure_ascii=True, sort_keys=True, indent=3)
    df = frame(spark)
    path = export.write(df, "json", str(tmp_path), "f.json", options=o)
    rows = plain(df, o)
    want = rows
    if o.metadata:
        meta = {"client": "c", "exported_at": "now", "format": "json", "version": "1.0", "total_comments": 4, "platforms": ["x", "y"]}
        want = {"metadata": meta | ({"stats": {"avg_likes": 3.25, "total_replies": 6}} if o.stats else {}), "comments": rows}
    with open(path, encoding="utf-8") as f:
        assert f.read() == json.dumps(want, indent=o.indent, sort_keys=o.sort_keys, ensure_ascii=o.ensure_ascii)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["f.json"]


@pytest.mark.parametrize("name", [*export.PRESETS, "ascii"])
def test_json_lines(spark, tmp_path, name):
    o = export.preset(name, client="c", exported_at="now") if name in export.PRESETS else export.Options(client="c", exported_at="now", ensure_ascii=True)
    df = frame(spark)
    got = read_lines = read(tmp_path / "f") if export.write(df, "jsonl", str(tmp_path), "f", options=o) else None
    lines = [json.loads(x) for x in got.splitlines()]
    if o.metadata_line:
        assert lines.pop(0) == {"type": "metadata", "client": "c", "exported_at": "now", "format": "jsonl", "version": "1.0", "total_comments": 4}
    assert lines == [{"type": "comment", **r} for r in plain(df, o)]
    assert [[*x] for x in lines] == [["type", *r] for r in plain(df, o)] and read_lines.isascii() == o.ensure_ascii


@pytest.mark.parametrize("changes", [{}, {"quoting": 1}, {"quoting": 2, "delimiter": ";"}, {"header": False, "line_end": "\r\n"}, {"quote_all": True, "rename": {"id": 'the "id"'}}])
def test_csv_is_what_the_csv_module_writes(spark, tmp_path, changes):
    o = export.Options(flatten_author=True, exclude=("published_at",), **changes)
    df = frame(spark, 1)
    export.write(df, "csv", str(tmp_path), "f", options=o)
    made = io.StringIO()
    w = csv.DictWriter(made, export.project(df, o).columns, delimiter=o.delimiter, quoting=1 if o.quote_all else o.quoting, lineterminator=o.line_end)
    if o.header:
        w.writeheader()
    w.writerows({k: "" if v is None else v for k, v in r.items()} for r in plain(df, o))
    with open(next((tmp_path / "f").glob("part-*")), encoding="utf-8", newline="") as f:
        assert f.read() == made.getvalue()


def test_parquet_follows_options(spark, tmp_path):
    path = export.write(frame(spark), "parquet", str(tmp_path), "f", options=export.Options(include=("id", "likes"), rename={"likes": "n"}))
    assert spark.read.parquet(path).columns == ["id", "n"]


def test_a_large_document_in_many_fragments(spark, tmp_path):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.to_json(F.struct("id")).alias("value"))
    documents.write_document(rows, f"{tmp_path}/big.json", {"meta": {"n": 1_000_000}}, "rows", indent=None)
    with open(tmp_path / "big.json") as f:
        held = json.load(f)
    assert held["meta"] == {"n": 1_000_000} and [x["id"] for x in held["rows"]] == [*range(1_000_000)]
    assert [p.name for p in tmp_path.iterdir()] == ["big.json"]


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "f.json").write_text("old")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.lit("{}")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        documents.write_document(bad, f"{tmp_path}/f.json", None, "x")
    assert [p.name for p in tmp_path.iterdir()] == ["f.json"] and (tmp_path / "f.json").read_text() == "old"
    documents.write_document(bad.limit(0), f"{tmp_path}/f.json", {"a": 1}, "x")
    assert json.loads((tmp_path / "f.json").read_text()) == {"a": 1, "x": []}


def test_account_and_company_files(spark, tmp_path):
    posts = spark.createDataFrame([("acc1", 3), ("acc1", 1), ("acc2", 5), ("acc3", 0)], "account_id string, comments_count long")
    comments = spark.createDataFrame([("acc1", f"k{i}", "p" if i % 2 else None) for i in range(3)] + [("acc2", "z", None)], "account_id string, id string, parent_id string")
    day = F.lit("2024-02-01").cast("date")
    head = results.account_document(posts, comments, "account_id").withColumns({"platform": F.lit("facebook"), "extracted_at": F.lit("t")})
    documents.account_files(head, comments, "account_id", str(tmp_path), day, ["id"])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.json")) == ["acc1/2024-02-01.json", "acc1/latest.json", "acc2/2024-02-01.json", "acc2/latest.json"]
    got = json.loads((tmp_path / "acc1" / "latest.json").read_text())
    assert got["stats"] == {"top_level_comments": 2, "replies": 1, "expected_comments": 4, "extraction_ratio": 0.75} and got["meta"] == {"version": "2.0", "extraction_type": "full", "posts_processed": 2, "is_complete": True}
    assert [c["id"] for c in got["comments"]] == ["k0", "k1", "k2"] and (got["account_id"], got["total_comments"]) == ("acc1", 3)
    rows = comments.withColumns({"company": F.lit("co"), "platform": F.lit("facebook")})
    documents.company_files(rows, ("company", "platform", "account_id"), "comments", f"{tmp_path}/c", F.lit("2024-02-01 03:04:05").cast("timestamp"), ["id"])
    got = json.loads((tmp_path / "c/co/facebook/acc1_comments_20240201_030405.json").read_text())
    assert got["metadata"] == {"company_id": "co", "platform": "facebook", "account": "acc1", "extracted_at": "2024-02-01T03:04:05", "total_comments": 3} and len(got["comments"]) == 3


@pytest.mark.parametrize("fmt", ["csv", "jsonl", "parquet"])
def test_one_write_into_many_folders(spark, tmp_path, fmt):
    df = frame(spark).withColumn("client", F.when(F.col("id") != "d", "c one"))
    export.write_by(df, fmt, f"{tmp_path}/o", ["client", "platform"], export.Options(include=("id", "text"), rename={"text": "said"}), tasks_each=2)
    folders = sorted(str(p.relative_to(tmp_path / "o")) for p in (tmp_path / "o").glob("*/*"))
    assert folders == ["client=__HIVE_DEFAULT_PARTITION__/platform=x", "client=c one/platform=x", "client=c one/platform=y"]
    rows = []
    for p in (tmp_path / "o").glob("*/*/part-*"):
        if fmt == "csv":
            with open(p, encoding="utf-8", newline="") as f:
                rows += [(r["id"], r["said"] or None) for r in csv.DictReader(f)]
        elif fmt == "jsonl":
            rows += [(r["id"], r["said"] or None) for r in map(json.loads, p.read_text(encoding="utf-8").splitlines())]
        else:
            rows += [(r.id, r.said or None) for r in spark.read.parquet(str(p)).collect()]
    assert sorted(rows) == sorted((r[0], r[2] or None) for r in ROWS)


@pytest.mark.parametrize("parts", [1, 5])
def test_many_documents_are_what_json_dump_writes(spark, tmp_path, parts):
    """Batches that end within a document, heads without rows, rows without a head, and strings that need escapes."""
    odd = "a\"b\\c\\u000B\n\r\t\b\f\x00\x0b\x1f\x7f/\u2028é漢😀"
    rows = [(f"d{i % 3}", i, odd if i % 2 else None, i % 5 == 0, f"v{i}") for i in range(50)] + [("lost", 1, "x", True, "v"), (None, 2, "y", None, None)]
    df = spark.createDataFrame(rows, 'account string, id long, `the "text"` string, flag boolean, file string').repartition(parts)
    heads = spark.createDataFrame([(f"d{i}", f'{{"n": {i}}}', f"copy{i}" if i else None) for i in range(4)], "file string, head string, copy string")
    own = [c for c in df.columns if c != "account"]
    want = {f"d{i}": {"n": i, "rows": [dict(zip(own, r[1:])) for r in rows if r[0] == f"d{i}"]} for i in range(4)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        documents.write_documents(heads, documents.objects(df, F.col("account"), own, ["id"], 2, documents.level({}, 2)), str(tmp_path), "rows")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["copy1", "copy2", "copy3", "d0", "d1", "d2", "d3"]
    for i in range(4):
        text = json.dumps(want[f"d{i}"], indent=2, ensure_ascii=False)
        assert (tmp_path / f"d{i}").read_bytes().decode() == text and (not i or (tmp_path / f"copy{i}").read_bytes().decode() == text)


def test_flat_rows_of_many_documents_need_no_python_and_one_shuffle(spark, tmp_path, monkeypatch):
    """Of account files, only heads pass a Python worker before the sink, and rows are shuffled by their file once."""
    saved = []
    monkeypatch.setattr(documents, "_save", lambda df, *a, **k: saved.append(df._jdf.queryExecution().sparkPlan().toString()))
    comments = spark.createDataFrame([("acc1", "k", 3, None)], "account_id string, id string, likes long, parent_id long")
    head = results.account_document(comments.withColumn("comments_count", F.lit(1)), comments, "account_id").withColumns({"platform": F.lit("x"), "extracted_at": F.lit("t")})
    documents.account_files(head, comments, "account_id", str(tmp_path), F.lit("2024-02-01").cast("date"), ["id"])
    assert saved[0].count("MapInArrow") == 1 and saved[0].count("Join") == 1
