"""Connected components by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.session import forget, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From links ``u``, ``v`` to ``node``, ``root``: the smallest node that is reachable, for every node of a link between two.

    Each round links all larger neighbours of a node to its smallest one, then the node itself and its smaller ones, so that paths halve. Aggregates combine before they
    shuffle and each round is written to the shared folder; a node with very many links is a key of joins alone, which adaptive execution splits. ``rounds`` guards against
    endless work: beyond it an error is raised.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = written(links, "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        forget(now)
        now = new
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
