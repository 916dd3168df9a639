"""Row filters: dates, required fields, and deny / allow rules kept as data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upcoming(df: DataFrame, today: dt.date, lookback: int = 0, col: str = "start_date") -> DataFrame:
    """Rows from ``today - lookback`` on; the bound is a literal, so it reaches the scan."""
    return df.filter(F.col(col) >= F.lit(today - dt.timedelta(days=lookback)))


def day_floor(df: DataFrame, today: dt.date, col: str = "logical_date") -> DataFrame:
    return df.filter(F.col(col) >= F.lit(today))


def within(
    df: DataFrame, col: str, today: dt.date, ahead: int | None = None, behind: int = 0
) -> DataFrame:
    """Rows from ``behind`` days ago up to ``ahead`` days from today, both inclusive."""
    out = df.filter(F.col(col) >= F.lit(today - dt.timedelta(days=behind)))
    if ahead is not None:
        out = out.filter(F.col(col) <= F.lit(today + dt.timedelta(days=ahead)))
    return out


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose listed fields are all present and not blank."""
    kept = df
    for c in cols:
        kept = kept.filter(F.trim(F.col(c).cast("string")) != "")
    return kept


@dataclass(frozen=True)
class Rule:
    """One deny or allow rule: ``kind`` is exact, prefix, contains or regex, on lower-cased text."""

    kind: str
    column: str
    value: str

    def hit(self) -> Column:
        text = F.lower(F.col(self.column))
        value = self.value.lower()
        match = {
            "exact": lambda: F.trim(text) == value,
            "prefix": lambda: F.startswith(text, F.lit(value)),
            "contains": lambda: F.contains(text, F.lit(value)),
            "regex": lambda: text.rlike(self.value),
        }[self.kind]()
        return F.coalesce(match, F.lit(False))


def _any(rules: Sequence[Rule]) -> Column:
    hit = F.lit(False)
    for rule in rules:
        hit = hit | rule.hit()
    return hit


def exclude(df: DataFrame, rules: Sequence[Rule], flags: Sequence[str] = ()) -> DataFrame:
    """Rows that no deny rule hits and whose hidden / expired / disabled flags are unset."""
    hit = _any(rules)
    for flag in flags:
        hit = hit | F.coalesce(F.col(flag), F.lit(False))
    return df.filter(~hit)


def include(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that at least one allow rule hits."""
    return df.filter(_any(rules))


def select_venues(
    venues: DataFrame,
    venue_categories: DataFrame,
    category: str | None = None,
    slugs: Sequence[str] | None = None,
) -> DataFrame:
    """Venues to process: all, those of a category, or the named ones.

    Columns ``slug, known``; a name nobody registered comes back with ``known`` false.
    ``venue_categories`` holds ``venue_slug, category_slug``.
    """
    if slugs is not None:
        wanted = venues.sparkSession.createDataFrame([(s,) for s in slugs], "slug string")
        have = venues.select("slug", F.lit(True).alias("known")).filter(F.col("slug").isin(*slugs))
        return wanted.join(have, "slug", "left").select(
            "slug", F.coalesce("known", F.lit(False)).alias("known")
        )
    if category is not None:
        members = venue_categories.filter(F.col("category_slug") == category)
        venues = venues.join(members, venues["slug"] == members["venue_slug"], "left_semi")
    return venues.select("slug", F.lit(True).alias("known"))
