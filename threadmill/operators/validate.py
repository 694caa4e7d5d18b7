"""Validation of records, and quality reports of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.numbers import rounded
from threadmill.functions.text import blank_to_null, strip


def _messages(*checks: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in checks]))


def _missing(c: str) -> Column:
    return blank_to_null(F.col(c).cast("string")).isNull()


def _verdict(df: DataFrame, errors: Column, warnings: Column, strict: bool) -> DataFrame:
    d = df.withColumn("errors", F.concat(errors, warnings) if strict else errors).withColumn("warnings", F.array().cast("array<string>") if strict else warnings)
    return d.withColumn("is_valid", F.size("errors") == 0)


def posts(df: DataFrame, now: Column, strict: bool = False) -> DataFrame:
    """Adds ``errors``, ``warnings`` and ``is_valid``; strict counts warnings as errors."""
    errors = _messages((_missing("platform_id"), "missing platform_id"), (_missing("platform"), "missing platform"), (_missing("account_id"), "missing account_id"), (F.col("likes") < 0, "negative likes"), (F.col("comments_count") < 0, "negative comments_count"))
    warnings = _messages((_missing("url"), "missing url"), (F.length("text") > 50000, "unusually long text"), (F.col("published_at") > now, "future published_at"))
    return _verdict(df, errors, warnings, strict)


def comments(df: DataFrame, now: Column | None = None, strict: bool = False, future_is_error: bool = False) -> DataFrame:
    """The same for comments; columns that a table lacks are not checked."""
    has = set(df.columns)
    errors = [(_missing(c), f"missing {c}") for c in ("platform_id", "post_id")]
    if "author" in has:
        errors.append((F.col("author").isNull(), "missing author"))
    errors.append((F.col("likes") < 0, "negative likes"))
    warnings = [(_missing("text"), "empty text")]
    if "author" in has:
        warnings.append((F.col("author").isNotNull() & blank_to_null(F.col("author.username")).isNull() & blank_to_null(F.col("author.display_name")).isNull(), "anonymous author"))
    warnings.append((F.length("text") > 10000, "unusually long text"))
    if "published_at" in has and now is not None:
        (errors if future_is_error else warnings).append((F.col("published_at") > now, "future date"))
    return _verdict(df, _messages(*errors), _messages(*warnings), strict)


def wrong_post(comments_: DataFrame, posts_: DataFrame) -> DataFrame:
    """Comments within a result whose post_id isn't their post's id. posts_: result_id, platform_id."""
    return comments_.join(posts_.select("result_id", F.col("platform_id").alias("of")), "result_id").where(F.col("post_id") != F.col("of"))


def before_first_invalid(df: DataFrame, order: str) -> DataFrame:
    """What fail-fast leaves: the rows before the first invalid one; one number reaches every row by an aggregate."""
    stop = df.agg(F.min(F.when(~F.col("is_valid"), F.col(order)))).first()[0]
    return df if stop is None else df.where(F.col(order) < stop)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def recommendation(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "acceptable").when(score >= 40, "review").otherwise("repeat")


def comment_rates(df: DataFrame, *keys: str, author: str = "author_username", time: str = "published_at") -> DataFrame:
    """text_rate, author_rate, timestamp_rate and duplicate_rate (by the first 50 characters); 0 where nothing is there. Two aggregates, each combined before it is shuffled."""
    d = df.withColumn("__head", F.left(F.coalesce("text", F.lit("")), F.lit(50)))
    per = d.groupBy(*keys, "__head").agg(
        F.count("*").alias("n"),
        F.count_if(F.length(strip(F.col("text"))) >= 5).alias("texts"),
        F.count_if(F.col(author).isNotNull() & ~F.col(author).isin("", "unknown")).alias("authors"),
        F.count_if(F.col(time).isNotNull()).alias("times"),
    )
    total = F.sum("n")
    rate = lambda c: F.when(total > 0, c / total).otherwise(0.0)
    return per.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0)).alias("comment_count"), rate(F.sum("texts")).alias("text_rate"), rate(F.sum("authors")).alias("author_rate"), rate(F.sum("times")).alias("timestamp_rate"), rate(F.sum(F.col("n") - 1)).alias("duplicate_rate")
    )


def quality(rates: DataFrame, post_count: Column, post_issues: Column, compat: bool = True) -> DataFrame:
    """Score, grade and recommendation. With ``compat`` 20 points always go, as a rate up to 1 is held against a length of 5; grade and recommendation go by the score before it is clamped."""
    text_low = F.col("text_rate") < (5 if compat else 0.5)
    ratio = F.when(post_count > 0, F.col("comment_count") / post_count)
    less = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    raw = F.lit(100) - post_issues * 5 - less(text_low, 20) - less(F.col("author_rate") < 0.7, 15) - less(F.col("duplicate_rate") > 0.1, 25) - less(ratio < 0.5, 10)
    return rates.withColumn("raw", raw).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw")))).withColumn("grade", grade(F.col("raw"))).withColumn("recommendation", recommendation(F.col("raw"))).drop("raw")


def post_issues(df: DataFrame, *keys: str) -> DataFrame:
    """Issues of a set of posts: none at all, texts missing in over half, any id missing."""
    n, no_text, no_id = F.count("*"), F.count_if(_missing("text")), F.count_if(_missing("platform_id"))
    return df.groupBy(*keys).agg(n.alias("post_count"), F.array_compact(F.array(F.when(n == 0, "No posts extracted"), F.when(no_text > n * 0.5, "Missing text"), F.when(no_id > 0, "Missing ids"))).alias("issues"))


def post_set_issues(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``post_issues`` of every expected key, also of those without posts."""
    found = post_issues(df, key)
    none = F.array(F.lit("No posts extracted"))
    return expected.select(key).distinct().join(found, key, "left").select(key, F.coalesce("post_count", F.lit(0)).alias("post_count"), F.coalesce("issues", none).alias("issues"))


def health(df: DataFrame) -> DataFrame:
    """Alerts for posts. df: containers, comments, text_rate, author_rate."""
    return df.withColumn("alerts", _messages(((F.col("containers") > 5) & (F.col("comments") == 0), "no comments"), ((F.col("containers") > 10) & (F.col("comments") < F.col("containers") * 0.1), "few comments"), (F.col("text_rate") < 0.5, "few texts"), (F.col("author_rate") < 0.3, "few authors")))


def gate(df: DataFrame) -> DataFrame:
    """Failures of a quality gate. df: valid_rate, duplicate_rate, author_rate, score."""
    return df.withColumn("failures", _messages((F.col("valid_rate") < 0.95, "valid_rate"), (F.col("duplicate_rate") > 0.01, "duplicate_rate"), (F.col("author_rate") < 0.80, "author_rate"), (F.col("score") < 70, "score")))


def measured_gate(df: DataFrame, key: str, author: str = "author_username") -> DataFrame:
    """The gate of each value of ``key`` over figures of all its comments: valid_rate, duplicate_rate, author_rate and score. A post is what its comments name; its text is any of theirs."""
    posts_ = df.groupBy(key, F.col("post_id").alias("platform_id")).agg(F.max("text").alias("text"))
    issues = post_issues(posts_, key).select(F.col(key).alias("__i"), "post_count", F.size("issues").alias("post_issues"))
    valid = comments(df).groupBy(F.col(key).alias("__v")).agg((F.count_if("is_valid") / F.count("*")).alias("valid_rate"))
    rates = comment_rates(df, key, author=author)
    rates = rates.join(issues, F.col(key).eqNullSafe(F.col("__i"))).join(valid, F.col(key).eqNullSafe(F.col("__v"))).drop("__i", "__v")
    return gate(quality(rates, F.col("post_count"), F.col("post_issues")))


def request_errors(df: DataFrame, platforms: tuple[str, ...]) -> DataFrame:
    """Errors of requests. df: name, identifier, platform, max_posts, max_comments, since, until."""
    bare = F.regexp_replace("identifier", "^@+", "")
    return df.withColumn("errors", _messages((~F.col("platform").isin(*platforms), "platform"), (~bare.rlike(r"^[a-zA-Z0-9._-]+$"), "identifier"), (~F.length("name").between(2, 255), "name"), (~F.col("max_posts").between(1, 1000), "max_posts"), (~F.col("max_comments").between(1, 10000), "max_comments"), (F.col("since") > F.col("until"), "date order")))


def list_errors(platforms: Column, known: tuple[str, ...]) -> Column:
    """Errors of a request's list of platforms: empty, unknown ones, or one named twice."""
    return F.filter(
        F.array(
            F.when(F.coalesce(F.size(platforms), F.lit(0)) < 1, "no platforms"), F.when(F.exists(platforms, lambda x: ~F.coalesce(x.isin(*known), F.lit(False))), "unknown platform"), F.when(F.size(F.array_distinct(platforms)) < F.size(platforms), "platforms not unique")
        ), lambda x: x.isNotNull()
    )


def uniqueness(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys and their share."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"), (F.count("*") / F.sum("n")).alias("uniqueness"))


def results(posts_: DataFrame, comments_: DataFrame, now: Column, strict: bool = False) -> DataFrame:
    """Each result's verdict: its post's messages, its comments' messages and comments of other posts, as ``errors``, ``warnings`` and ``is_valid``. Both have ``result_id``; comments have ``seq``, by which their messages are ordered."""
    p = posts(posts_, now, strict).select("result_id", F.col("platform_id").alias("of"), F.col("errors").alias("own_errors"), F.col("warnings").alias("own_warnings"))
    c = comments(comments_, now, strict).join(p.select("result_id", "of"), "result_id")
    foreign = F.when(F.coalesce(F.col("post_id") != F.col("of"), F.lit(True)), F.concat(F.lit("Comment "), F.col("platform_id").cast("string"), F.lit(" has post_id "), F.coalesce(F.col("post_id").cast("string"), F.lit("None")), F.lit(" but belongs to post "), F.col("of").cast("string")))
    c = c.withColumn("errors", F.concat("errors", F.array_compact(F.array(foreign)))).where((F.size("errors") > 0) | (F.size("warnings") > 0))
    gathered = lambda column: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", column))), lambda x: x[column]))
    per = c.groupBy("result_id").agg(gathered("errors").alias("errors"), gathered("warnings").alias("warnings"))
    none = F.array().cast("array<string>")
    d = p.join(per, "result_id", "left").select("result_id", F.col("of").alias("platform_id"), F.concat("own_errors", F.coalesce("errors", none)).alias("errors"), F.concat("own_warnings", F.coalesce("warnings", none)).alias("warnings"))
    return d.withColumn("is_valid", F.size("errors") == 0)


def valid_results(verdicts: DataFrame) -> DataFrame:
    """The valid ones; raises with the first five messages if there are results and none is valid."""
    if verdicts.where("is_valid").isEmpty():
        first = [f"{r.platform_id}: {r.errors}" for r in verdicts.orderBy("result_id").limit(5).collect()]
        if first:
            raise ValueError(f"all results are invalid; first errors: {first}")
    return verdicts.where("is_valid")


def batch_report(verdicts: DataFrame, *keys: str, samples: int = 100) -> DataFrame:
    """Results, valid and invalid ones, the share of valid ones and up to ``samples`` first messages."""
    d = verdicts.withColumn("message", F.get("errors", F.lit(0)))
    first = F.slice(F.array_sort(F.collect_set("message")), 1, samples)
    return d.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), (F.count_if("is_valid") / F.count("*")).alias("valid_rate"), first.alias("messages"))


def completeness(posts_: DataFrame, comments_: DataFrame, *keys: str, author: str = "author_username") -> DataFrame:
    """Shares of posts with text and time, and of comments with author and time; passed with over 90 % of posts timed and over 80 % of comments named."""
    share = lambda cond: F.count_if(cond) / F.count("*")
    p = posts_.groupBy(*keys).agg(share(~_missing("text")).alias("post_text_rate"), share(F.col("published_at").isNotNull()).alias("post_timestamp_rate"))
    c = comments_.groupBy(*keys).agg(share(~_missing(author)).alias("comment_author_rate"), share(F.col("published_at").isNotNull()).alias("comment_timestamp_rate"))
    d = p.join(c, [*keys], "full") if keys else p.join(c)
    d = d.select(*keys, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("post_text_rate", "post_timestamp_rate", "comment_author_rate", "comment_timestamp_rate")])
    return d.withColumn("passed", (F.col("post_timestamp_rate") > 0.9) & (F.col("comment_author_rate") > 0.8))


def consistency(posts_: DataFrame, comments_: DataFrame, key: str) -> DataFrame:
    """Orphans and issues of each ``key``: an issue is a post with under half the comments that it says, of over ten, and the orphans together. Passed without orphans and with issues for a tenth of posts at most. posts_: key, platform_id, comments_count; comments_: key, post_id."""
    n = comments_.groupBy(F.col(key).alias("k"), "post_id").agg(F.count("*").alias("actual"))
    both = posts_.select(key, F.col("platform_id").alias("id"), "comments_count").join(n, (F.col(key) == F.col("k")) & (F.col("id") == F.col("post_id")), "full")
    short = F.col("id").isNotNull() & (F.coalesce("actual", F.lit(0)) < F.col("comments_count") * 0.5) & (F.col("comments_count") > 10)
    d = both.groupBy(F.coalesce(key, "k").alias(key)).agg(F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("actual"))), F.lit(0)).alias("orphan_comments"), F.count_if(short).alias("short_posts"), F.count("id").alias("posts"))
    d = d.withColumn("issues", F.col("short_posts") + (F.col("orphan_comments") > 0).cast("int"))
    return d.withColumn("passed", (F.col("orphan_comments") == 0) & (F.col("issues") <= F.col("posts") * 0.1))


def freshness(posts_: DataFrame, now: Column, *keys: str) -> DataFrame:
    """Oldest and newest post, the age of the newest in hours, and whether it is younger than seven days."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.max("published_at"))) / 3600
    return posts_.groupBy(*keys).agg(F.min("published_at").alias("oldest_post"), F.max("published_at").alias("newest_post"), age.alias("data_age_hours"), F.coalesce(age < 168, F.lit(False)).alias("passed"))


def repeated_ids(comments_: DataFrame, *keys: str) -> DataFrame:
    """Comments, distinct platform and id, repeats and their share, of each key."""
    g = comments_.groupBy(*keys, "platform", "platform_id").agg(F.count("*").alias("n"))
    return g.groupBy(*keys).agg(F.sum("n").alias("total_comments"), F.count("*").alias("unique_comments"), (F.sum("n") - F.count("*")).alias("duplicates"), ((F.sum("n") - F.count("*")) / F.sum("n")).alias("duplicate_rate"))


def combined_score(complete: Column, author_rate: Column, consistent: Column, issues: Column, fresh: Column, duplicate_rate: Column, digits: int | None = 2) -> Column:
    """25 points for each check that passed; else a share of authors, two less for each issue, none, and the share without repeats. digits: None leaves the score as it is, for callers that round it themselves."""
    score = F.when(complete, 25.0).otherwise(author_rate * 25) + F.when(consistent, 25.0).otherwise(F.greatest(F.lit(0.0), 25.0 - issues * 2)) + F.when(fresh, 25.0).otherwise(0.0) + F.when(duplicate_rate == 0, 25.0).otherwise(25 * (1 - duplicate_rate))
    return score if digits is None else rounded(score, digits)
