"""Elements of pages: nesting by running depths over tags, so that an element's text comes out of what is nested in it.

Tags are rows. For each page and tag name a window's running sum gives the depth of every opening and closing tag, and the next tag at an opening tag's depth closes it. Only names that are looked for
are followed, so that tags of other names that nobody closes do no harm; an element that is never closed ends with its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PIECES = r"(?s)<[^>]*>|[^<]+"
_SILENT = r"(?is)<!--.*?-->|<(script|style)[^>]*>.*?</(script|style)>|<link[^>]*>"
#: Roles and classes by which a page shows a dialog or an error, and what is too long for an error.
DIALOG_ROLES, ALERT_ROLES, ERROR_CLASSES, ERROR_CHARS = ["dialog", "alertdialog"], ["alert"], ["error", "warning"], 500
#: Elements that hold nothing.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag, with either kind of quotes or none; null where it isn't there."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.nullif(F.regexp_replace(value, """^["']|["']$""", ""), F.lit(""))


def has_class(tag: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(attribute(tag, "class"), r"\s+"), F.array(*[F.lit(n) for n in names])), F.lit(False))


def has_role(tag: Column, roles: list[str]) -> Column:
    return F.coalesce(attribute(tag, "role").isin(roles), F.lit(False))


def is_dialog(tag: Column) -> Column:
    return has_role(tag, DIALOG_ROLES) | has_class(tag, "modal") | F.coalesce(attribute(tag, "aria-modal") == "true", F.lit(False))


def is_error(tag: Column) -> Column:
    """By role, by class, or by a class whose name holds error."""
    return has_role(tag, ALERT_ROLES) | has_class(tag, *ERROR_CLASSES) | F.coalesce(attribute(tag, "class").rlike("error|Error"), F.lit(False))


def elements(pages: DataFrame, wanted: list[tuple[str, Column | object]], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id, ``kind``, ``at`` (the tag's number in the page), ``tag``, ``name`` and ``text`` of every element for whose opening tag one of ``wanted`` holds: pairs of a kind and a function of the tag. Scripts, styles and comments are no text; white space runs are one space. Pages whose html is null have none."""
    cut = pages.select(F.col(id_col), F.regexp_extract_all(F.regexp_replace(html_col, _SILENT, ""), F.lit(_PIECES), F.lit(0)).alias("pieces"))
    tags = cut.select(id_col, F.posexplode("pieces").alias("at", "tag")).withColumn("name", F.lower(F.regexp_extract("tag", r"^</?([a-zA-Z][a-zA-Z0-9-]*)", 1))).where("name <> ''")
    opens = ~F.startswith("tag", F.lit("</"))
    alone = F.col("name").isin(VOID) | F.endswith("tag", F.lit("/>"))
    kinds = F.filter(F.array(*[F.when(opens & test(F.col("tag")), F.lit(kind)) for kind, test in wanted]), lambda x: x.isNotNull())
    tags = tags.withColumn("kinds", kinds)
    names = tags.where(F.size("kinds") > 0).select(id_col, "name").distinct()
    followed = tags.join(names, [id_col, "name"], "left_semi")
    of_name = Window.partitionBy(id_col, "name").orderBy("at")
    step = F.when(alone, 0).when(opens, 1).otherwise(-1)
    depth = F.sum(step).over(of_name) + F.when(opens, 0).otherwise(1)
    same = Window.partitionBy(id_col, "name", "depth", "alone").orderBy("at")
    closed = followed.withColumn("depth", depth).withColumn("alone", alone).withColumn("end", F.when(F.col("alone"), F.col("at")).otherwise(F.lead("at").over(same)))
    found = closed.where(F.size("kinds") > 0).select(id_col, "at", "tag", "name", "end", F.explode("kinds").alias("kind"))
    inside = F.when(F.col("end") == F.col("at"), F.array().cast("array<string>")).otherwise(F.slice("pieces", F.col("at") + 2, F.greatest(F.coalesce("end", F.size("pieces")) - F.col("at") - 1, F.lit(0))))
    text = F.trim(F.regexp_replace(F.array_join(F.transform(inside, lambda x: F.when(F.startswith(x, F.lit("<")), " ").otherwise(x)), ""), r"[\x20\x09-\x0D]+", " "))
    return found.join(cut, id_col).select(id_col, "kind", "at", "tag", "name", text.alias("text"))


def signs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Dialogs, with ``role`` (unknown where there is none) and ``classes``, and errors of a text below 500 characters: id, ``kind``, ``at``, ``role``, ``classes``, ``text``."""
    found = elements(pages, [("dialog", is_dialog), ("error", is_error)], id_col, html_col)
    kept = found.where((F.col("kind") == "dialog") | ((F.col("text") != "") & (F.length("text") < ERROR_CHARS)))
    return kept.select(id_col, "kind", "at", F.coalesce(attribute(F.col("tag"), "role"), F.lit("unknown")).alias("role"), F.coalesce(attribute(F.col("tag"), "class"), F.lit("")).alias("classes"), "text")
