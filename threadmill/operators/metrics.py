"""Metrics of extraction runs, rates and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Runs, totals, durations and errors per run (which can pass 1)."""
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("posts").alias("posts"), F.sum("comments").alias("comments"), F.avg("duration").alias("avg_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), (F.sum("errors") / F.count("*")).alias("error_rate"))


def rate(n: Column, seconds: Column) -> Column:
    """Per second, 0 for no time."""
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def session_rates(df: DataFrame, *keys: str) -> DataFrame:
    """Posts a minute and comments a minute, and errors a request, of each session; 0 for no time or no requests. df: posts, comments, errors, requests, seconds."""
    g = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("posts", "comments", "errors", "requests", "seconds")])
    return g.select(*keys, (rate(F.col("posts"), F.col("seconds")) * 60).alias("posts_per_minute"), (rate(F.col("comments"), F.col("seconds")) * 60).alias("comments_per_minute"), rate(F.col("errors"), F.col("requests")).alias("error_rate"))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def metric_key(name: Column, labels: Column) -> Column:
    """``name{k=v,...}`` with sorted labels."""
    pairs = F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return F.when(F.size(pairs) > 0, F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(name)


def counters(df: DataFrame, key: str) -> DataFrame:
    """Sum, last value and number of points of each key. df: key, ts, value."""
    return df.groupBy(key).agg(F.sum("value").alias("total"), F.max_by("value", "ts").alias("last"), F.count("*").alias("points"))


def anomalies(df: DataFrame) -> DataFrame:
    """df: posts, errors, comments, minutes. Slow, failing and poor runs."""
    total = F.col("posts") + F.col("errors")
    checks = [
        F.when((F.col("posts") > 5) & (rate(F.col("posts"), F.col("minutes")) < 0.5), "slow"),
        F.when((total > 10) & (F.col("errors") / F.greatest(total, F.lit(1)) > 0.3), "errors"),
        F.when((F.col("posts") > 5) & (F.col("comments") / F.greatest("posts", F.lit(1)) < 0.1), "few comments"),
    ]
    return df.withColumn("alerts", F.array_compact(F.array(*checks)))


def sliding(df: DataFrame, key: str, ts: str = "published_at", seconds: int = 60) -> DataFrame:
    """Events of the same key in the last ``seconds``, each event's own included. Windows are over a key and a span of time, and the rows of the seconds before a span are counted in it too, so that a busy key is dealt to many tasks. Rows without a time go."""
    span = max(seconds * 10, 600)
    rows = df.withColumn("__at", F.unix_timestamp(ts))
    both = F.array_distinct(F.array(F.floor(F.col("__at") / span), F.floor((F.col("__at") + seconds - 1) / span)))
    w = Window.partitionBy(key, "__span").orderBy("__at").rangeBetween(1 - seconds, 0)
    counted = rows.withColumn("__span", F.explode(both)).withColumn("in_window", F.count("*").over(w))
    return counted.where(F.floor(F.col("__at") / span) == F.col("__span")).drop("__at", "__span")


def adaptive_delay(df: DataFrame, key: str, order: str, outcome: str, base: int = 2000, least: int = 500, most: int = 30000, up: float = 1.5, down: float = 0.9, successes: int = 10) -> DataFrame:
    """Delay in ms after a key's outcomes (success, rate_limit or error) in order. A fold over one array of each key: successes shrink the delay, and their count restarts only if it did; limits grow it; second errors in a row grow it by a fifth."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(outcome).alias("o")))), lambda x: x.o)
    start = F.struct(F.lit(base).alias("d"), F.lit(0).alias("s"), F.lit(0).alias("e"))

    def step(acc: Column, o: Column) -> Column:
        shrunk = F.greatest((acc.d * down).cast("int"), F.lit(least))
        due = (acc.s + 1 >= successes) & (shrunk < acc.d)
        ok = F.struct(F.when(due, shrunk).otherwise(acc.d).alias("d"), F.when(due, 0).otherwise(acc.s + 1).alias("s"), F.lit(0).alias("e"))
        limited = F.struct(F.least((acc.d * up).cast("int"), F.lit(most)).alias("d"), F.lit(0).alias("s"), (acc.e + 1).alias("e"))
        failed = F.struct(F.when(acc.e + 1 > 1, F.least((acc.d * 1.2).cast("int"), F.lit(most))).otherwise(acc.d).alias("d"), F.lit(0).alias("s"), (acc.e + 1).alias("e"))
        return F.when(o == "success", ok).when(o == "rate_limit", limited).otherwise(failed)

    done = df.groupBy(key).agg(F.aggregate(seq, start, step).alias("x"))
    return done.select(key, F.col("x.d").alias("delay_ms"), F.col("x.e").alias("consecutive_errors"), (F.col("x.e") < 3).alias("may_continue"))


def retained(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return df.where(F.unix_timestamp("started_at") > F.unix_timestamp(now) - hours * 3600)
