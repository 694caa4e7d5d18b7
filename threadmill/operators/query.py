"""Filters, counts and pages over posts and comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_rows(df: DataFrame, client: str | None = None, platform: str | None = None, since: Column | None = None, until: Column | None = None, limit: int = 0) -> DataFrame:
    """Newest first, between inclusive bounds; rows without a date go where there is a bound. No limit for 0."""
    for c, v in (("client", client), ("platform", platform)):
        if v is not None:
            df = df.where(F.col(c) == v)
    if since is not None:
        df = df.where(F.col("published_at") >= since)
    if until is not None:
        df = df.where(F.col("published_at") <= until)
    if not limit:
        return df
    return df.orderBy(F.desc_nulls_last("published_at"), "seq").limit(limit)


def since_or_undated(df: DataFrame, since: Column) -> DataFrame:
    return df.where(F.col("published_at").isNull() | (F.col("published_at") >= since))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` from 1, by a total order. Spark keeps only the first number * size rows of every partition."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("page from 1, size from 1 to 500")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Texts that occur more than once, their ids in order, and a preview."""
    from threadmill.functions.text import preview

    g = df.groupBy(*keys, "text").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("platform_id")).alias("ids")).where("n > 1")
    return g.select(*keys, preview(F.col("text")).alias("text"), "n", "ids")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are repeats of others; 0 where there are none."""
    g = df.groupBy(*keys, "text").agg(F.count("*").alias("n"))
    return g.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def without_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    return posts.join(comments.select(F.col("post_id").alias("platform_id")).distinct(), "platform_id", "left_anti")


def orphans(comments: DataFrame, posts: DataFrame) -> DataFrame:
    return comments.join(posts.select(F.col("platform_id").alias("post_id")), "post_id", "left_anti")


def until_known(df: DataFrame, order: str, known: str, stop: int, *keys: str) -> DataFrame:
    """The rows before the ``stop``-th known one."""
    seen = F.sum(F.col(known).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__seen", seen).where(F.col("__seen") < stop).drop("__seen")


def until_failures(df: DataFrame, order: str, failed: str, most: int, *keys: str) -> DataFrame:
    """The rows up to the end of the first run of ``most`` failures."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__island", F.sum((~F.col(failed)).cast("int")).over(w))
    row = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(*keys, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__row", row)
    d = d.withColumn("__over", F.coalesce(F.max((F.col("__row") >= most).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.where("__over = 0").drop("__island", "__row", "__over")


def best_tier(df: DataFrame, tier: str, *keys: str) -> DataFrame:
    """Rows of the lowest tier that a key has."""
    return df.withColumn("__t", F.min(tier).over(Window.partitionBy(*keys))).where(F.col(tier) == F.col("__t")).drop("__t")


#: Labels of buttons, which are no comments.
BUTTONS = ("like", "reply", "me gusta", "responder", "share", "compartir", "translate", "verified")
_BUTTON_COUNT = r"(?i)^[0-9]+\s*(like|me gusta|reply|responder|share|compartir)s?$"
_CAPTIONS = (r"^[0-9]+[hdwms]?$", r"(?i)^[0-9]+\s*(like|repl|day|hour|week|ago)", r"(?i)^View\s+(all)?", r"(?i)^Hide\s+repl")
#: Accented letters and what they are searched as.
_ACCENTS, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def not_button_text(text: Column) -> Column:
    """Whether a text is more than the label of a button, a count of reactions, an age or a link to more."""
    plain = F.trim(text)
    label = F.lower(plain).isin(*BUTTONS) | plain.rlike(_BUTTON_COUNT)
    for pattern in _CAPTIONS:
        label = label | plain.rlike(pattern)
    return F.coalesce(~label, F.lit(False))


def same_word(a: Column, b: str) -> Column:
    """Equality without regard to case; null never matches."""
    return F.coalesce(F.lower(a) == b.lower(), F.lit(False))


def with_comments(posts: DataFrame, least: int, first: int, order: str, count: str = "comments_count") -> DataFrame:
    """Posts with so many comments at least, the first of them in their order; all where ``first`` is 0."""
    d = posts.where(F.col(count) >= least)
    return d.orderBy(order).limit(first) if first else d


def search(df: DataFrame, platform: str | None = None, since: Column | None = None, until: Column | None = None, author: object = None, text: str | None = None) -> DataFrame:
    """Comments by platform, dates, author and a part of the text in any case; each may be left out."""
    d = select_rows(df, platform=platform, since=since, until=until)
    if author is not None:
        d = d.where(F.col("author_id") == author)
    return d.where(F.contains(F.lower("text"), F.lit(text.lower()))) if text else d


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(text), _ACCENTS, _PLAIN)


def word_index(df: DataFrame, id_col: str = "seq") -> DataFrame:
    """An inverted index: ``word`` (without accents and case) and the id of every row that has it, each pair once. Written partitioned or bucketed by word, it answers searches without reading texts."""
    words = F.split(unaccented(F.col("text")), r"[^\p{L}\p{N}]+")
    return df.select(F.col(id_col), F.explode(F.array_distinct(words)).alias("word")).where("word <> ''")


def having_words(index: DataFrame, words: list[str], id_col: str = "seq") -> DataFrame:
    """Ids of the rows that have all the words. Words are not stemmed."""
    plain = index.sparkSession.range(1).select(F.explode(F.array_distinct(F.array(*[unaccented(F.lit(w)) for w in words]))).alias("word"))
    hits = index.join(F.broadcast(plain), "word", "left_semi").groupBy(id_col).agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len({w.lower().translate(str.maketrans(_ACCENTS, _PLAIN)) for w in words})).select(id_col)


def until_known_batches(df: DataFrame, batch: str, known: str, share: float, stop: int, *keys: str) -> DataFrame:
    """Rows up to the end of the ``stop``-th batch in a row of which at least this share is known."""
    per = df.groupBy(*keys, batch).agg((F.count_if(known) >= F.count("*") * share).alias("failed"))
    kept = until_failures(per, batch, "failed", stop, *keys).select(*keys, batch)
    return df.join(kept, [*keys, batch], "left_semi")


def newest_text_first(column: str) -> Column:
    """Newest first by dates as text; missing ones are last."""
    return F.coalesce(F.col(column), F.lit("")).desc()
