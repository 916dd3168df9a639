"""Reports and summaries. All are partial aggregates: hot groups shrink before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(c: str, df: DataFrame) -> Column:
    if df.schema[c].dataType.simpleString().startswith("array"):
        return F.size(c) > 0
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def coverage(
    df: DataFrame,
    by: str = "venue_slug",
    fields: Sequence[str] = ("start_time", "price", "image_url", "annotations", "external_id"),
) -> DataFrame:
    """Per venue: rows, and count and floor-percent of rows with each field."""
    out = df.groupBy(by).agg(
        F.count("*").alias("n"), *[F.count_if(_filled(f, df)).alias(f"with_{f}") for f in fields]
    )
    for f in fields:
        out = out.withColumn(f"pct_{f}", F.floor(F.col(f"with_{f}") * 100 / F.col("n")).cast("bigint"))
    return out


def category_counts(df: DataFrame, col: str = "category_slugs") -> DataFrame:
    """Events per category; an event counts once in each of its categories."""
    return df.select(F.explode(col).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def duplicate_ids(df: DataFrame, by: str = "venue_slug", col: str = "external_id") -> DataFrame:
    """Per venue: rows minus distinct ids (a missing id counts as a duplicate), and clashing ids.

    Ids are counted first, so a venue's rows are spread over its ids before they meet.
    """
    ids = df.groupBy(by, col).agg(F.count("*").alias("_n"))
    return ids.groupBy(by).agg(
        (F.sum("_n") - F.count(col)).alias("dupes"),
        F.count_if(F.col(col).isNotNull() & (F.col("_n") > 1)).alias("clashing_ids"),
    )


def clashing_ids(df: DataFrame, by: str = "venue_slug", col: str = "external_id") -> DataFrame:
    """The ids that several rows of a venue share."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(by, col)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def run_report(results: DataFrame, by: str = "venue_slug") -> DataFrame:
    """Per venue: ok or not, events written, first error. ``results`` holds ``pos`` and ``error``."""
    return results.groupBy(by).agg(
        (F.count("error") == 0).alias("ok"),
        F.when(F.count("error") == 0, F.count("*")).otherwise(0).alias("n_events"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("first_error"),
    )


def hour_profile(df: DataFrame, hour: Column | str, offsets: Sequence[int]) -> DataFrame:
    """Events per local hour under several candidate clock offsets."""
    h = F.col(hour) if isinstance(hour, str) else hour
    base = df.groupBy(h.alias("_h")).agg(F.count("*").alias("_n"))
    return (
        base.withColumn("offset_hours", F.explode(F.array(*[F.lit(o) for o in offsets])))
        .withColumn("hour", F.pmod(F.col("_h") + F.col("offset_hours"), F.lit(24)))
        .groupBy("offset_hours", "hour")
        .agg(F.sum("_n").alias("n"))
    )


def list_summary(agenda: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows per (locale, list) page, zero included."""
    n = agenda.groupBy("locale", "list_slug").agg(F.count("*").alias("_n"))
    return keys.join(n, ["locale", "list_slug"], "left").select(
        "locale", "list_slug", F.coalesce("_n", F.lit(0)).alias("n"),
        F.col("_n").isNull().alias("is_empty"),
    )
