"""Dates. Relative times refer to a column or literal ``now``, never to the clock."""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(c: Column) -> Column:
    """An ISO timestamp, UTC without an offset; null where it can't be read."""
    return F.regexp_replace(c, "Z", "+00:00").try_cast("timestamp")


def parse_flexible(c: Column) -> Column:
    """ISO, then a few fixed formats."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(parse_iso(c), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def relative_token(c: Column, compat: bool = True) -> Column:
    """A token such as 5h. With ``compat``, "2mo" gives "2m", as minutes are tried before months."""
    units = "s|m|h|d|w|mo|y" if compat else "s|mo|m|h|d|w|y"
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), rf"^([0-9]+\s*(?:{units}))", 1), r"\s", ""), F.lit(""))


def _ago(now: Column, n: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) - n * seconds)


def relative_comment(c: Column, now: Column) -> Column:
    """Relative time in English or Spanish. Tests are ordered: an h anywhere means hours, so "2 months" and "Thursday 5" are hours, and "29 sem" - an m at its end, no h - minutes."""
    t = F.lower(F.trim(c))
    n = F.regexp_extract(t, "([0-9]+)", 1).try_cast("bigint")
    has = lambda *xs: F.coalesce(*[F.when(F.contains(t, F.lit(x)), True) for x in xs], F.lit(False))
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(has("just now", "ahora", "hace un momento"), now)
        .when(has("yesterday", "ayer"), _ago(now, F.lit(1), 86400))
        .when(n.isNull(), None)
        .when(has("min") | (F.endswith(t, F.lit("m")) & ~has("h")), _ago(now, n, 60))
        .when(has("h"), _ago(now, n, 3600))
        .when(has("d"), _ago(now, n, 86400))
        .when(has("w", "sem"), _ago(now, n, 604800))
        .when(has("mes"), _ago(now, n, 30 * 86400))
        .when(has("y", "año"), _ago(now, n, 365 * 86400))
    )


def relative_review(c: Column, now: Column) -> Column:
    """Relative date of a review; ``now`` where nothing is said."""
    t = F.lower(F.trim(c))
    n = F.coalesce(F.regexp_extract(t, "([0-9]+)", 1).try_cast("bigint"), F.lit(1))
    out = F
    for unit, seconds in (("year", 365 * 86400), ("month", 30 * 86400), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60)):
        out = out.when(F.contains(t, F.lit(unit)), _ago(now, n, seconds))
    return out.otherwise(now)


#: Month names, of which the first three letters are enough.
MONTHS = {
    "en": "january february march april may june july august september october november december".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}


def _months() -> dict[str, int]:
    """Whole and short names of both languages, with their numbers."""
    return {name[:n]: k for names in MONTHS.values() for k, name in enumerate(names, 1) for n in (3, 4, len(name))} | {"setiembre": 9}


def fuzzy_date(c: Column, now: Column) -> Column:
    """A date anywhere in a text: a day and a month's name in English or Spanish in either order, numbers with the day first (or the month, where the first two can only be so read), or year, month and day; with or without a year, a time, am and pm.

    Without a year it is that of ``now``, or the one before if the date would lie ahead; two digits of a year lie within fifty years of ``now``; a time alone is today's. Null where there is neither a date nor a time, or no such day.
    """
    return _let(F.lower(c), lambda t: _fuzzy(t, now))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _fuzzy(t: Column, now: Column) -> Column:
    found = lambda pattern, k: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    number = lambda pattern, k: found(pattern, k).try_cast("int")
    first = lambda *xs: F.coalesce(*xs)
    names = _months()
    name = rf"(?<!\p{{L}})({'|'.join(sorted(names, key=len, reverse=True))})(?!\p{{L}})"
    day_first, month_first = rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:de\s+|of\s+)?{name}", rf"{name}\.?\s+(\d{{1,2}})(?!\d|:)"
    iso, numbers = r"(?<!\d)(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?!\d)", r"(?<!\d)(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
    clock, hour_only = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:([ap])\.?\s?m)?", r"(?<!\d)(\d{1,2})\s*([ap])\.?\s?m(?!\p{L})"

    month_number = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), found(name, 1))
    x, y = number(numbers, 1), number(numbers, 2)
    month_leads = (y > 12) & (x <= 12)
    short = number(numbers, 3)
    month = first(number(iso, 2), F.when(month_leads, x).otherwise(y), month_number)
    day = first(number(iso, 3), F.when(month_leads, y).otherwise(x), number(day_first, 1), number(month_first, 2))
    year = first(number(iso, 1), F.when(short >= 100, short).when(short + 2000 > F.year(now) + 50, short + 1900).otherwise(short + 2000), number(r"(?<![\d:])(\d{4})(?![\d:])", 1))
    half = first(found(clock, 4), found(hour_only, 2))
    hour = first(number(clock, 1), number(hour_only, 1))
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(F.coalesce(hour, F.lit(0)))
    minute, second = F.coalesce(number(clock, 2), F.lit(0)), F.coalesce(number(clock, 3), F.lit(0))
    time_alone = month.isNull() & day.isNull() & (found(clock, 1).isNotNull() | found(hour_only, 1).isNotNull())
    month, day = F.when(time_alone, F.month(now)).otherwise(month), F.when(time_alone, F.dayofmonth(now)).otherwise(F.when(month.isNotNull(), F.coalesce(day, F.dayofmonth(now))))
    at = lambda y: F.try_make_timestamp(y, month, day, hour, minute, second)
    this_year = at(F.year(now))
    return F.when(year.isNotNull(), at(year)).when(this_year > now, at(F.year(now) - 1)).otherwise(this_year)


def relative_post(c: Column, now: Column) -> Column:
    """Relative time in English or Spanish, then a date by ``fuzzy_date``, then minutes, hours or days that are named anywhere behind a number."""
    return _let(F.lower(F.trim(c)), lambda t: _post(t, now))


def _post(t: Column, now: Column) -> Column:
    n = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("bigint")
    unit = lambda pattern: F.regexp_extract(t, pattern, 2)
    short, hace, ago = r"^([0-9]+)\s*([hmd])$", r"hace\s+([0-9]+)\s+(hora|minuto|día|min|hr|d)", r"([0-9]+)\s+(minute|hour|day|min|hr)"
    has = lambda *xs: t.rlike("|".join(xs))

    def past(pattern: str) -> Column:
        u = unit(pattern)
        return F.when(F.startswith(u, F.lit("m")), _ago(now, n(pattern), 60)).when(F.startswith(u, F.lit("h")), _ago(now, n(pattern), 3600)).otherwise(_ago(now, n(pattern), 86400))

    return (
        F.when(t == "", None)
        .when(has("just now", "ahora", "hace un momento"), now)
        .when(n(short).isNotNull(), past(short))
        .when(n(hace).isNotNull(), past(hace))
        .when(n(ago).isNotNull() & has("ago"), past(ago))
        .when(has("yesterday", "ayer"), _ago(now, F.lit(1), 86400))
        .when(has("today", "hoy"), now)
        .otherwise(F.coalesce(_fuzzy(t, now), F.when(has("min"), _ago(now, n("([0-9]+)"), 60)).when(has("hour", "hr", "hora"), _ago(now, n("([0-9]+)"), 3600)).when(has("day", "día"), _ago(now, n("([0-9]+)"), 86400))))
    )


def formatted(c: Column, style: str, pattern: str | None = None, zone: str | None = None) -> Column:
    """``iso``, ``iso_date``, ``timestamp`` (epoch seconds as text), ``human`` or ``custom`` with a pattern, in UTC or a zone; a zone that nobody knows is ignored."""
    try:
        known_zone = bool(zone) and zoneinfo.ZoneInfo(zone) is not None
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        known_zone = False
    at = F.from_utc_timestamp(c, zone) if known_zone else c
    if style == "timestamp":
        return F.unix_timestamp(c).cast("string")
    known = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "iso_date": "yyyy-MM-dd", "human": "MMM dd, yyyy hh:mm a"}
    return F.date_format(at, pattern if style == "custom" else known[style])


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    return F.when(s < 60, text(s, "s")).when(s < 3600, text(F.floor(s / 60), "m ", s % 60, "s")).otherwise(text(F.floor(s / 3600), "h ", F.floor((s % 3600) / 60), "m"))


def duration(started: Column, completed: Column) -> Column:
    """Seconds, null while open."""
    return (F.unix_micros(completed) - F.unix_micros(started)) / 1e6


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def quiet_hours(c: Column) -> Column:
    return F.hour(c).between(2, 5)
