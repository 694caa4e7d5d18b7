"""String functions. Java's ``\\w`` and ``\\s`` are ASCII, so patterns name Unicode classes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
#: The emoji blocks that count.
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"
SPACE = r"(?U)\s+"


def blank_to_null(c: Column) -> Column:
    """Empty strings are as good as missing ones."""
    return F.nullif(c, F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Runs of white space become one space; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, SPACE, " ")), F.lit(""))


def clean_comment(c: Column) -> Column:
    """Without NUL characters and outer white space."""
    return strip(F.regexp_replace(c, r"\x00", ""))


@F.pandas_udf(T.StringType())
def normalise_nfkc(s: pd.Series) -> pd.Series:
    """NFKC; there is no built-in function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def normalise_nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def clean_nfkc(c: Column) -> Column:
    """NFKC, one space for white space, and no control or format characters but line ends and tabs."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(normalise_nfkc(c), r"\x00", ""), SPACE, " ")), r"[\p{C}&&[^\n\r\t]]", "")


def preprocess_comment(c: Column) -> Column:
    """NFKD, lower case, without URLs and mentions."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(normalise_nfkd(c)), r"(?U)http\S+|www\S+", ""), rf"@{WORD}+", "")
    return F.trim(F.regexp_replace(bare, SPACE, " "))


def extract_username(c: Column) -> Column:
    """Without one leading @; null unless it is made of word characters and dots."""
    bare = F.regexp_replace(strip(c), "^@", "")
    return F.when(bare.rlike(r"^[\p{L}\p{N}_.]+$"), bare)


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"#({WORD}+)"), F.lit(1))


def mentions(c: Column, dots: bool = True) -> Column:
    return F.regexp_extract_all(c, F.lit(r"@([\p{L}\p{N}_.]+)" if dots else rf"@({WORD}+)"), F.lit(1))


def urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)https?://\S+"), F.lit(0))


def emojis(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(EMOJI), F.lit(0)), "")


def truncate(c: Column, size: int = 100, suffix: str = "...") -> Column:
    """At most ``size`` characters, the suffix included."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, max(size - len(suffix), 0)), F.lit(suffix))).otherwise(c)


def preview(c: Column, size: int = 100) -> Column:
    """The first characters, and the suffix besides."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def words(c: Column) -> Column:
    """Distinct words in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def html_text(c: Column) -> Column:
    """Without scripts, styles, stylesheet links and tags."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<link[^>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


def html_title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)
