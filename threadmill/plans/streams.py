"""Queries that run a stream over the event table to its end and return what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.plans.core import FOLD, register
from threadmill.session import exists, shared_path
from threadmill.sources.adapters import table
from threadmill.streaming import events


def _drained(frame, mode, *keys):
    """What a stream gives over all its input. Every micro-batch writes a folder of its own, again if it is repeated; of a complete output the last one counts, of updates each key's last row."""
    spark = frame.sparkSession
    at = shared_path(spark, f"stream-{uuid.uuid4().hex}")

    def write(batch, number):
        batch.withColumn("__n", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/out/b{number}")

    frame.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*frame.schema.fields, T.StructField("__n", T.LongType())])
    done = spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).parquet(f"{at}/out") if exists(spark, f"{at}/out") else spark.createDataFrame([], schema)
    if mode == "complete":
        last = done.agg(F.max("__n")).first()[0]
        done = done.where(F.col("__n") == last) if last is not None else done
    elif mode == "update":
        rest = [c for c in frame.columns if c not in keys]
        done = done.groupBy(*keys).agg(*[F.max_by(c, "__n").alias(c) for c in rest])
    return done.select(*frame.columns)


def _stream(s, d):
    return s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return _drained(events.windowed(_stream(s, d), "ts", "1 hour", "1 day", "event_type"), "complete")


@register("stream_routed", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'info' ELSE 'error' END AS level FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def _(s, d):
    return _drained(events.route(_stream(s, d)).select("event_id", "level"), "append")


@register("stream_progress", "SELECT user_id, count(*) AS done, round(100.0 * count(*) / 1000, 1)::DOUBLE AS percent FROM events GROUP BY 1")
def _(s, d):
    return _drained(events.progress(_stream(s, d), 1000, "user_id"), "complete")


@register("stream_limiter", f"WITH RECURSIVE {FOLD} SELECT key AS user_id, d::BIGINT AS delay_ms, e::BIGINT AS consecutive_errors FROM last")
def _(s, d):
    outcome = F.when(F.col("event_type") == "error", "rate_limit").when(F.col("event_type") == "click", "error").otherwise("success")
    return _drained(events.limiter(_stream(s, d).select("user_id", outcome.alias("outcome"), "event_id"), "user_id", "outcome"), "update", "user_id")


@register("stream_outcomes", "SELECT user_id, count(*) AS n, CASE WHEN bool_or(event_type = 'error' AND value > 70) THEN 'failed' WHEN bool_or(event_type = 'purchase' AND value > 50) OR count(*) >= 1000 THEN 'completed' ELSE 'running' END AS state, CASE WHEN NOT bool_or(event_type = 'error' AND value > 70) AND (bool_or(event_type = 'purchase' AND value > 50) OR count(*) >= 1000) THEN 100.0 ELSE round_even(100.0 * count(*) / 1000, 1) END::DOUBLE AS percent FROM events GROUP BY 1")
def _(s, d):
    done, failed = (F.col("event_type") == "purchase") & (F.col("value") > 50), (F.col("event_type") == "error") & (F.col("value") > 70)
    return _drained(events.outcome(_stream(s, d), 1000, done, failed, "user_id"), "complete")
