"""Numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = {"k": 1_000.0, "m": 1_000_000.0, "b": 1_000_000_000.0}


def _scaled(number: Column, unit: Column) -> Column:
    factor = F.coalesce(*[F.when(unit == u, F.lit(x)) for u, x in _SCALE.items()], F.lit(1.0))
    return F.coalesce((number.try_cast("double") * factor).cast("bigint"), F.lit(0).cast("bigint"))


def parse_count_basic(c: Column) -> Column:
    """The first number with an optional k, m or b behind it - which may begin a longer word, so that "5 minutes" is five million. Commas group digits."""
    low = F.lower(c)
    number = F.regexp_replace(F.regexp_extract(low, r"([0-9,.]+)\s*([kmb])?", 1), ",", "")
    return F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(_scaled(F.nullif(number, F.lit("")), F.regexp_extract(low, r"([0-9,.]+)\s*([kmb])?", 2)))


def parse_count_intl(c: Column) -> Column:
    """English and Spanish counts. "mill" anywhere means millions and "mil" thousands, with Spanish separators; else a unit must end a word, and of both separators the later one is the decimal one."""
    low = F.trim(F.lower(c))
    first = F.regexp_extract(low, r"([0-9,.]+)", 1)
    spanish = F.regexp_replace(F.regexp_replace(first, r"\.", ""), ",", ".")
    with_unit = F.regexp_extract(low, r"\b([0-9,.]+)\s*([kmb])\b", 1)
    unit = F.regexp_extract(low, r"\b([0-9,.]+)\s*([kmb])\b", 2)
    bounded = F.regexp_extract(low, r"\b([0-9,.]+)\b", 1)
    raw = F.coalesce(F.nullif(with_unit, F.lit("")), F.nullif(bounded, F.lit("")), F.nullif(first, F.lit("")))
    comma, dot = F.instr(F.reverse(raw), ","), F.instr(F.reverse(raw), ".")
    plain = (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", "."))
        .when((comma > 0) & (dot > 0), F.regexp_replace(raw, ",", ""))
        .when(raw.rlike(r",[0-9]{1,2}$"), F.regexp_replace(raw, ",", "."))
        .otherwise(F.regexp_replace(raw, ",", ""))
    )
    none = F.lit(0).cast("bigint")
    return (
        F.when(c.isNull() | raw.isNull(), none)
        .when(F.contains(low, F.lit("mill")), F.coalesce((spanish.try_cast("double") * 1_000_000).cast("bigint"), none))
        .when(F.contains(low, F.lit(" mil")) | F.endswith(low, F.lit("mil")), F.coalesce((spanish.try_cast("double") * 1_000).cast("bigint"), none))
        .otherwise(_scaled(plain, unit))
    )


def extract_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("bigint"))


def first_number(c: Column) -> Column:
    """The first integer; 1 for "a" and "an", and where there is none."""
    return F.coalesce(F.regexp_extract(c, "([0-9]+)", 1).try_cast("bigint"), F.lit(1).cast("bigint"))


def rating(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, "([0-9,.]+)", 1), ",", ".").try_cast("double")


def price_level(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\$+)", 1), F.lit(""))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def hover_count(c: Column) -> Column:
    """A count as a page's script reads it: as ``parse_count_basic``, but a number with a unit is rounded half up instead of cut."""
    low = F.lower(c)
    number = F.regexp_replace(F.regexp_extract(low, r"([0-9,.]+)\s*([kmb])?", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(low, r"([0-9,.]+)\s*([kmb])?", 2)
    factor = F.coalesce(*[F.when(unit == u, F.lit(x)) for u, x in _SCALE.items()], F.lit(1.0))
    return F.coalesce(round_half_up(number * factor).cast("bigint"), F.lit(0).cast("bigint"))


def valid_count_text(c: Column) -> Column:
    """Whether text can be a count: at most 100 characters, and not digits and letters in many turns."""
    digits, letters = F.length(F.regexp_replace(c, "[^0-9]", "")), F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    turns = F.regexp_count(c, F.lit(r"(?<=[0-9])\p{L}|(?<=\p{L})[0-9]"))
    return F.coalesce((F.length(c) <= 100) & ~((digits > 3) & (letters > 20) & (turns > 5)), F.lit(False))
