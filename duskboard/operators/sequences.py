"""Order-dependent reading of pages: headers carried to their rows, months that roll over.

A page normally has a few hundred lines, but nothing here relies on it. Lines are cut into equal
ranges of their position; each range is read on its own, its summary (last header, number of month
changes) is a partial aggregate, and the summaries of the ranges before it are added at the end. No
task holds a whole page, and a page has at most ``SLICES`` summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskboard.operators.ranking import cells


def _cut(df: DataFrame, pos: str) -> DataFrame:
    return df.withColumn("_cell", cells(df, pos, 1000))


def _fill(df: DataFrame, cols: Sequence[str], page: str, pos: str, forward: bool) -> DataFrame:
    pick, take = (F.max_by, F.last) if forward else (F.min_by, F.first)
    start, end = (Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing)
    outer = (Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)
    cut = _cut(df, pos)
    inside = Window.partitionBy(page, "_cell").orderBy(pos).rowsBetween(start, end)
    across = Window.partitionBy(page).orderBy("_cell").rowsBetween(*outer)
    summary = cut.groupBy(page, "_cell").agg(
        *[pick(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_s_{c}") for c in cols]
    )
    carry = summary.select(
        page, "_cell", *[take(f"_s_{c}", ignorenulls=True).over(across).alias(f"_c_{c}") for c in cols]
    )
    filled = cut.withColumns({f"_f_{c}": take(c, ignorenulls=True).over(inside) for c in cols})
    joined = filled.join(carry, [page, "_cell"])
    return joined.select(
        *[F.coalesce(f"_f_{c}", f"_c_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def forward_fill(df: DataFrame, cols: str | Sequence[str], page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Carry the last header down to the rows under it."""
    return _fill(df, [cols] if isinstance(cols, str) else list(cols), page, pos, forward=True)


def backward_fill(df: DataFrame, cols: str | Sequence[str], page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Give each row the next header below it."""
    return _fill(df, [cols] if isinstance(cols, str) else list(cols), page, pos, forward=False)


def roll_months(
    df: DataFrame, month_start: str, day: str = "day", page: str = "page_id", pos: str = "pos", out: str = "date"
) -> DataFrame:
    """Dates of a page's day numbers: whenever the number drops, the month moves on.

    ``month_start`` holds the first day of the page's opening month. Impossible days become null.
    """
    cell = [page, "_cell"]
    by_pos = Window.partitionBy(*cell).orderBy(pos)
    so_far = by_pos.rowsBetween(Window.unboundedPreceding, 0)
    cut = _cut(df, pos).withColumn("_wrap", F.when(F.col(day) < F.lag(day).over(by_pos), 1).otherwise(0))
    ranges = cut.groupBy(*cell).agg(
        F.sum("_wrap").alias("_n"), F.min_by(day, pos).alias("_first"), F.max_by(day, pos).alias("_last")
    )
    cells = Window.partitionBy(page).orderBy("_cell")
    edge = F.when(F.col("_first") < F.lag("_last").over(cells), 1).otherwise(0)
    before = ranges.withColumn("_edge", edge).select(
        *cell,
        (
            F.coalesce(F.sum("_n").over(cells.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            + F.sum("_edge").over(cells.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("_before"),
    )
    counted = cut.withColumn("_months", F.sum("_wrap").over(so_far)).join(before, cell)
    first = F.add_months(F.col(month_start), (F.col("_months") + F.col("_before")).cast("int"))
    date = F.date_add(first, F.col(day).cast("int") - 1)
    return counted.select(*df.columns, F.when(F.month(date) == F.month(first), date).alias(out))
