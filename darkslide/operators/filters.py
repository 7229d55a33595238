"""Predicates of the catalogue; each is a Column, inactive criteria are true."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def rating_at_least(r: int | None) -> Column:
    return F.coalesce(F.col("rating") >= r, F.lit(False)) if r else F.lit(True)


def has_tag(tag: str | None) -> Column:
    """A whole tag, without regard to case and outer space."""
    t = (tag or "").strip().lower()
    return F.coalesce(F.exists("tags", lambda x: F.lower(F.trim(x)) == t), F.lit(False)) if t else F.lit(True)


def exif_value(*tags: str) -> Column:
    """The first non-empty of some EXIF tags, else the empty string."""
    return F.coalesce(*[F.nullif(F.try_element_at("exif", F.lit(t)), F.lit("")) for t in tags], F.lit(""))


def date_prefix(prefix: str | None) -> Column:
    return exif_value("DateTimeOriginal", "DateTime").startswith(prefix) if prefix else F.lit(True)


def is_manual(strict_source: bool = False) -> Column:
    """Labelled by hand. With ``strict_source`` the source alone counts, and a missing one is manual."""
    source = F.coalesce("label_source", F.lit("manual")) == "manual"
    return source if strict_source else source & (F.trim(text("label")) != "")


def not_manual(active: bool) -> Column:
    return ~is_manual() if active else F.lit(True)


def filename_contains(part: str | None) -> Column:
    return F.lower(text("filename")).contains(part.lower()) if isinstance(part, str) and part else F.lit(True)


def exif_field_contains(field: str, value: str) -> Column:
    hit = F.exists(F.map_entries("exif"), lambda e: (F.lower(e["key"]) == field.lower()) & F.lower(e["value"]).contains(value.lower()))
    return F.coalesce(hit, F.lit(False))


def matches(rating: int | None = None, tag: str | None = None, date: str | None = None, hide_manual: bool = False) -> Column:
    return reduce(Column.__and__, [not_manual(hide_manual), rating_at_least(rating), has_tag(tag), date_prefix(date)])


def unlabelled() -> Column:
    return F.trim(text("label")) == ""


def trains() -> Column:
    return F.lower(F.trim(text("label"))).isin("keep", "trash") & (F.coalesce("label_source", F.lit("manual")) == "manual")


def problems() -> Column:
    """What is wrong with a row: names in a fixed order, empty if nothing."""
    bad = [
        F.when(F.col("rating").isNull() | ~F.col("rating").between(0, 5), "rating"),
        F.when(F.col("tags").isNull() | F.exists("tags", lambda t: t.isNull() | (F.trim(t) == "")), "tags"),
        F.when(~F.lower(F.trim(text("label"))).isin("", "keep", "trash"), "label"),
        F.when(~F.coalesce("label_source", F.lit("manual")).isin("manual", "auto"), "label_source"),
    ]
    return F.array_compact(F.array(*bad))
