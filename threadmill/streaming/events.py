"""Event streams: routing, progress, deduplicated ingest and the adaptive limiter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadmill.functions.numbers import rounded
from threadmill.streaming.bus import Bus

#: How events are announced.
ROUTES = [
    ("purchase", "success", "Purchase completed"),
    ("signup", "info", "New signup"),
    ("error", "error", "Error reported"),
]
#: The nine kinds of events that a run announces, their level and title.
RUN_ROUTES = [
    ("extraction.completed", "success", "Extraction Completed"),
    ("auth.login_success", "info", "Login Successful"),
    ("storage.exported", "success", "Data Exported"),
    ("rate_limit.warning", "warning", "Rate Limit Warning"),
    ("rate_limit.detected", "warning", "Rate Limit Detected"),
    ("warning.occurred", "warning", "Warning"),
    ("extraction.failed", "error", "Extraction Failed"),
    ("auth.login_failed", "error", "Login Failed"),
    ("error.occurred", "error", "Error Occurred"),
]


def read(spark: SparkSession, path: str, schema: object, max_files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def route(events: DataFrame, routes: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Events with their level and title; types without a route go. The routes are a handful of literals."""
    table = F.broadcast(events.sparkSession.createDataFrame(routes or ROUTES, "event_type string, level string, title string"))
    return events.join(table, "event_type")


def windowed(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "1 day", *keys: str) -> DataFrame:
    """Counts of windows; what comes later than the watermark allows is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).start.alias("start"), *keys).agg(F.count("*").alias("n"))


def new_rows(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys])


def fan_out(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Give every batch to all handlers in their order; one that fails doesn't keep the batch from others. ``bus.Bus`` counts failures and lets handlers come and go."""
    bus = Bus()
    for handle in handlers.values():
        bus.subscribe_all(handle)
    return bus.attach(events, checkpoint)


def to_parquet(events: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def limiter(events: DataFrame, key: str, outcome: str, base: int = 2000, least: int = 500, most: int = 30000, successes: int = 10) -> DataFrame:
    """The adaptive delay as a stream: the state of each key is its delay, successes and errors in a row. A key's rows of one micro-batch are put in the order of the last column; ``read``'s max_files bounds them."""

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, good, bad = state.get if state.exists else (base, 0, 0)
        pdf = pd.concat([*rows])
        for o in pdf.sort_values(pdf.columns[-1])[outcome]:
            if o == "success":
                good, bad = good + 1, 0
                if good >= successes and (shrunk := max(int(delay * 0.9), least)) < delay:
                    delay, good = shrunk, 0
            elif o == "rate_limit":
                delay, good, bad = min(int(delay * 1.5), most), 0, bad + 1
            else:
                bad, good = bad + 1, 0
                if bad > 1:
                    delay = min(int(delay * 1.2), most)
        state.update((delay, good, bad))
        yield pd.DataFrame({key: [k[0]], "delay_ms": [delay], "consecutive_errors": [bad]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, delay_ms bigint, consecutive_errors bigint", "delay bigint, good bigint, bad bigint", "update", GroupStateTimeout.NoTimeout)


def outcome(events: DataFrame, total: int, done: Column, failed: Column, *keys: str) -> DataFrame:
    """Progress of each source with its state: failed once a failure is seen, completed at its total or once an end is seen, else running; a completed one has 100 percent."""
    g = events.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.coalesce(done, F.lit(False))).alias("ended"), F.max(F.coalesce(failed, F.lit(False))).alias("broken"))
    state = F.when(F.col("broken"), "failed").when(F.col("ended") | (F.col("n") >= total), "completed").otherwise("running")
    percent = F.when(state == "completed", 100.0).otherwise(rounded(100.0 * F.col("n") / F.lit(max(total, 1)), 1))
    return g.select(*keys, "n", state.alias("state"), percent.alias("percent"))


def progress(events: DataFrame, total: int, *keys: str) -> DataFrame:
    """Percent done of each source, one decimal."""
    return events.groupBy(*keys).agg(F.count("*").alias("done")).withColumn("percent", rounded(100.0 * F.col("done") / F.lit(max(total, 1)), 1))
