import pytest
from pyspark.sql import functions as F

from threadmill.operators import export, markup
from threadmill.streaming.bus import Bus, Progress


def test_nested_elements(spark):
    html = """<html><body><div class="x"><div role='dialog' class="big modal">Hello <div>inner <p>one<p>two <b>bold</div> tail<br/>
        <span class="has-Error now">Bad   thing</span><style>.a{}</style></div>after</div><div class=warning>W</div><div role=alert></div><section aria-modal="true">open to the end <i>x"""
    long = "<p class='error'>" + "e" * 600 + "</p><p class='error'>short</p>"
    df = spark.createDataFrame([(1, html, "z"), (2, long, "z"), (3, None, "z"), (4, "no tags", "z"), (5, "<div class='modal'/><img class='error'>", "z")], "page_id long, html string, name string")
    got = sorted((x.page_id, x.kind, x.role, x.classes, x.text) for x in markup.signs(df).collect())
    assert got == [
        (1, "dialog", "dialog", "big modal", "Hello inner one two bold tail Bad thing"), (1, "dialog", "unknown", "", "open to the end x"), (1, "error", "unknown", "has-Error now", "Bad thing"), (1, "error", "unknown", "warning", "W"),
        (2, "error", "unknown", "error", "short"), (5, "dialog", "unknown", "modal", ""),
    ]
    assert markup.signs(df.limit(0)).count() == 0


def test_bus_order_failures_and_leaving(spark, tmp_path):
    spark.createDataFrame([(1, "error"), (2, "click"), (3, "error")], "id int, event_type string").write.parquet(f"{tmp_path}/in")
    bus, seen = Bus(), []

    def first(rows, n):
        seen.append(("first", sorted(r.id for r in rows.collect())))

    def broken(rows, n):
        raise ValueError("no")

    def every(rows, n):
        seen.append(("every", rows.count()))

    def nobody(rows, n):
        seen.append(("nobody", 0))

    assert [bus.subscribe("error", broken), bus.subscribe_all(every), bus.subscribe("error", first), bus.subscribe("purchase", nobody)] == [1, 2, 3, 4]
    assert (bus.handler_count(), bus.handler_count("error"), bus.handler_count("none")) == (4, 2, 0)
    stream = lambda: spark.readStream.schema("id int, event_type string").parquet(f"{tmp_path}/in")
    bus.attach(stream(), f"{tmp_path}/c1").awaitTermination()
    assert seen == [("first", [1, 3]), ("every", 3)] and bus.failures == {"broken": 1} and bus.calls == {"first": 1, "every": 1}
    assert bus.unsubscribe("error", broken) and not bus.unsubscribe("error", broken) and not bus.unsubscribe("none", first) and bus.unsubscribe_all(every) and not bus.unsubscribe_all(every)
    bus.attach(stream(), f"{tmp_path}/c2").awaitTermination()
    assert seen[2:] == [("first", [1, 3])] and bus.failures == {"broken": 1}
    bus.clear("error")
    assert bus.handler_count() == 1
    bus.clear()
    assert bus.handler_count() == 0


def test_progress_from_sparks_events(spark, tmp_path):
    spark.range(40).repartition(2).write.parquet(f"{tmp_path}/in")
    seen = Progress({"work": 80})
    spark.streams.addListener(seen)
    try:
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.queryName("work").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(50):
            if seen.state.get("work") == "completed":
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(seen)
    assert seen.rows["work"] == 40 and seen.batches["work"] >= 2 and seen.state["work"] == "completed" and seen.percent("work") == 100.0
    seen.state["work"] = "running"
    assert seen.percent("work") == 50.0 and seen.percent("other") == 0.0


@pytest.mark.parametrize("first", ["constant", "prefix"])
def test_batches_split_what_is_hot(spark, first, monkeypatch):
    held = []
    write = export.written
    monkeypatch.setattr(export, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    df = spark.range(0, 20_000, 1, 5).select((F.lit("one value") if first == "constant" else F.concat(F.lit("same beginning "), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("a"), (F.col("id") * 7919 % 20_011).alias("b"))
    order = ["a", "b"]
    made = export.batches(df, order, 100, rows_each=1000)
    assert [r.batch for r in made.orderBy(*order).collect()] == [i // 100 + 1 for i in range(20_000)]
    sizes = [r["count"] for r in held[0].groupBy("__p").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3000
