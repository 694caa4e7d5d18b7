"""Profiles, classes and patterns of commenters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.numbers import rounded

#: Words that name an issue.
ISSUES = {
    "coverage": ["cobertura", "señal", "signal", "red", "network"],
    "billing": ["factura", "cobro", "pago", "bill", "charge"],
    "speed": ["lento", "velocidad", "slow", "speed", "mbps"],
    "service": ["atención", "servicio", "customer service"],
    "app": ["app", "aplicación", "application"],
}


def profiles(df: DataFrame) -> DataFrame:
    """Per author: comments, mean likes, platforms, first and last time, and comments a month of 30 days."""
    g = df.groupBy("author_id").agg(F.count("*").alias("total_comments"), F.avg("likes").alias("avg_likes"), F.array_sort(F.collect_set("platform")).alias("platforms"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    months = F.greatest(F.datediff("last_seen", "first_seen") / 30.0, F.lit(1.0))
    return g.withColumn("per_month", F.col("total_comments") / months)


def classify(n: Column, positive: Column, negative: Column) -> Column:
    return F.when((n >= 20) & (positive >= 0.7), "super_fan").when((n >= 10) & (positive >= 0.6), "frequent_positive").when((n >= 10) & (negative >= 0.6), "frequent_negative").when(n >= 3, "occasional").otherwise("one_time")


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each class; the classes are few."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    return g.withColumn("percent", rounded(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def influence(verified: Column, avg_likes: Column, n: Column, reply_ratio: Column, days_since: Column, digits: int | None = 2) -> Column:
    """0 to 100: verified 20, likes up to 30, comments up to 20, replies up to 15, recency 15 or 7.5. digits: None leaves the score as it is, for callers that round it themselves."""
    days = F.coalesce(days_since, F.lit(365))
    score = F.when(F.coalesce(verified, F.lit(False)), 20.0).otherwise(0.0) + F.least(avg_likes / 10 * 30, F.lit(30.0)) + F.least(n / 20 * 20, F.lit(20.0)) + F.least(reply_ratio * 15, F.lit(15.0)) + F.when(days <= 30, 15.0).when(days <= 90, 7.5).otherwise(0.0)
    return score if digits is None else rounded(score, digits)


def issue_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Texts that name each issue, and the issue with most; ties go to the first, none gives null."""
    low = F.lower(F.coalesce("text", F.lit("")))
    named = lambda words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in words], F.lit(False))
    g = df.groupBy(*keys).agg(*[F.count_if(named(w)).alias(i) for i, w in ISSUES.items()])
    top = F.greatest(*ISSUES)
    return g.withColumn("primary_issue", F.when(top > 0, F.coalesce(*[F.when(F.col(i) == top, F.lit(i)) for i in ISSUES])))


def summary(profiles_: DataFrame) -> DataFrame:
    """Totals, mean, upper median, one-time commenters and the return rate. The median is found by counts of each value, so that no task holds all authors."""
    per = profiles_.groupBy("total_comments").agg(F.count("*").alias("k"))
    w = Window.orderBy("total_comments").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("upto", F.sum("k").over(w)).withColumn("all", F.sum("k").over(Window.partitionBy()))
    return ranked.agg(
        F.sum("k").alias("commenters"), (F.sum(F.col("k") * F.col("total_comments")) / F.sum("k")).alias("mean_comments"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("total_comments"))).alias("median_comments"),
        F.coalesce(F.sum(F.when(F.col("total_comments") == 1, F.col("k"))), F.lit(0)).alias("one_time"), (F.sum(F.when(F.col("total_comments") > 1, F.col("k")).otherwise(0)) / F.sum("k")).alias("return_rate"),
    )


def top_share(profiles_: DataFrame, share: float = 0.1) -> DataFrame:
    """Share of comments that come from the top ``share`` of commenters; of equal ones any may count, the sum is the same."""
    per = profiles_.groupBy("total_comments").agg(F.count("*").alias("k"))
    w = Window.orderBy(F.desc("total_comments")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.floor(F.sum("k").over(Window.partitionBy()) * share)
    taken = F.greatest(F.lit(0), F.least(F.col("k"), room - F.coalesce(F.sum("k").over(w), F.lit(0))))
    d = per.withColumn("taken", taken)
    return d.agg((F.sum(F.col("taken") * F.col("total_comments")) / F.sum(F.col("k") * F.col("total_comments"))).alias("share"))


def cross_platform(df: DataFrame, single: tuple[str, ...]) -> DataFrame:
    """Authors on one of the named platforms alone, or on several; those on another single one are not counted."""
    g = df.groupBy("author_id").agg(F.count_distinct("platform").alias("n"), F.min("platform").alias("p"))
    bucket = F.when(F.col("n") > 1, "multi").when(F.col("p").isin(*single), F.concat("p", F.lit("_only")))
    return g.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def consistency(scores: DataFrame) -> DataFrame:
    """Per author: whether the variance of its mean score over platforms is below 0.1; null on fewer than two. scores: author_id, platform, score."""
    per = scores.groupBy("author_id", "platform").agg(F.avg("score").alias("score"))
    return per.groupBy("author_id").agg(F.when(F.count("*") >= 2, F.var_pop("score") < 0.1).alias("consistent"))


def by_hour(df: DataFrame) -> DataFrame:
    return df.groupBy(F.hour("published_at").alias("hour")).agg(F.count("*").alias("n"))


def by_weekday(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("published_at", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def heatmap(df: DataFrame) -> DataFrame:
    """Weekdays by hours."""
    return df.select(F.dayofweek("published_at").alias("weekday"), F.hour("published_at").alias("hour")).groupBy("weekday").pivot("hour", [*range(24)]).count()


def reply_ratio(df: DataFrame) -> DataFrame:
    """Per author the share of its comments that are replies. df: author_id, is_reply."""
    return df.groupBy("author_id").agg((F.count_if("is_reply") / F.count("*")).alias("reply_ratio"))


def verified_count(df: DataFrame) -> DataFrame:
    """Authors, and those that are verified in any of their comments. df: author_id, verified."""
    return df.groupBy("author_id").agg(F.max("verified").alias("v")).agg(F.count("*").alias("commenters"), F.count_if("v").alias("verified"))


def peaks(df: DataFrame, *keys: str) -> DataFrame:
    """The hour and the weekday with most comments; of equal ones the one that is seen first. df: published_at, seq."""
    def peak(part: Column, name: str) -> DataFrame:
        g = df.groupBy(*keys, part.alias(name)).agg(F.count("*").alias("n"), F.min(F.struct("published_at", "seq")).alias("first"))
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first")
        return g.withColumn("k", F.row_number().over(order)).where("k = 1").select(*keys, name, F.col("n").alias(f"{name}_count"))

    hours, days = peak(F.hour("published_at"), "peak_hour"), peak(F.date_format("published_at", "EEEE"), "peak_weekday")
    return hours.join(days, [*keys]) if keys else hours.join(days)


def sentiment(df: DataFrame, *keys: str) -> DataFrame:
    """Positive, negative and neutral rows of each key, such as a platform or a day. df: label (positive, negative, or anything else)."""
    return df.groupBy(*keys).agg(F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"), F.count_if(~F.coalesce(F.col("label").isin("positive", "negative"), F.lit(False))).alias("neutral"))


def contact_sentiment(df: DataFrame) -> DataFrame:
    """Per author the score of its first and last comment and its distinct topics. df: author_id, published_at, seq, score, topics."""
    at = F.struct("published_at", "seq")
    ends = df.groupBy("author_id").agg(F.min_by("score", at).alias("first_score"), F.max_by("score", at).alias("last_score"))
    topics = df.select("author_id", F.explode("topics").alias("topic")).groupBy("author_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    return ends.join(topics, "author_id", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def progression(df: DataFrame) -> DataFrame:
    """The positive scores of each author in order, as rows with their ``place``: the list that a journey shows, without an array that grows with an author. df: author_id, published_at, seq, score."""
    place = F.row_number().over(Window.partitionBy("author_id").orderBy("published_at", "seq"))
    return df.where("score > 0").select("author_id", place.alias("place"), "published_at", "score")


def journey(df: DataFrame) -> DataFrame:
    """Per author: first and last contact, and the trend between the halves of the positive scores, with 3 of these at least. df: author_id, published_at, seq, score."""
    own = Window.partitionBy("author_id")
    positive = F.when(F.col("score") > 0, 1)
    placed = df.withColumn("__k", F.count(positive).over(own.orderBy("published_at", "seq"))).withColumn("__m", F.count(positive).over(own))
    early = F.col("__k") <= F.floor(F.col("__m") / 2)
    mean = lambda c: F.avg(F.when(c & (F.col("score") > 0), F.col("score")))
    g = placed.groupBy("author_id").agg(F.min("published_at").alias("first_contact"), F.max("published_at").alias("last_contact"), F.count("*").cast("int").alias("n"), F.max("__m").alias("__m"), (mean(~early) - mean(early)).alias("__c"))
    trend = F.when(F.col("__m") >= 3, F.when(F.col("__c") > 0.1, "improving").when(F.col("__c") < -0.1, "declining").otherwise("stable"))
    return g.select("author_id", "first_contact", "last_contact", "n", trend.alias("trend"))
