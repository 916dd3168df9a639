"""Positions and picks inside groups that may be very large."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskboard.functions.text import let

#: How many ranges a group is cut into; bounds the running sum to a constant number of cells.
SLICES = 256


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key. An aggregate, so each task sends one row per key and no group is gathered."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; see :func:`keep_first`."""
    return _keep(df, keys, order, F.max_by)


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    by = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        pick(row, by).alias("_row")
    ).select("_row.*")


def cells(values: DataFrame, column: str, least_width: int = 1) -> Column:
    """Number of the range a value lies in, ascending with the value; ``values`` covers all of them.

    Negative values and the others are cut apart, each into equal ranges between their own bounds: minted
    keys spread over all negative numbers, serial ones stand close together, and either kind is cut evenly.
    The division is in floating point, so no bounds overflow; it is monotone, so the order holds.
    """
    v = F.col(column).cast("double")
    below, above = F.when(v < 0, v), F.when(v >= 0, v)
    bounds = values.agg(*[f(side).alias(n) for side, names in ((below, "ab"), (above, "cd")) for f, n in zip((F.min, F.max), names)])
    b = bounds.select(F.struct("a", "b", "c", "d").alias("b")).scalar()

    def number(lo: Column, hi: Column) -> Column:
        width = F.greatest((hi - lo + 1) / SLICES, F.lit(float(least_width)))
        return F.floor((v - lo) / width)

    return F.when(v < 0, number(b["a"], b["b"]) - 2 * SLICES).otherwise(number(b["c"], b["d"]))


#: Cells of :func:`with_balanced_cell`, a power of two; and the accuracy of their bounds' ranks.
BALANCED, ACCURACY = 128, 2000


def with_balanced_cell(df: DataFrame, values: DataFrame, column: str, out: str = "_cell") -> DataFrame:
    """``df`` with the number of the cell a value lies in, ascending with the value: as many of ``values`` in each, whatever
    far-off ones there are. The bounds are quantiles of a mergeable sketch, one short array for all tasks; equal values are
    one cell. Null is the first cell."""
    ranks = F.lit([i / BALANCED for i in range(1, BALANCED)])
    bounds = values.agg(F.percentile_approx(F.col(column), ranks, ACCURACY).alias("b")).scalar()

    def search(step: int) -> Callable[[Column], Column]:
        return lambda i: i + F.when(F.col(column) >= F.get("_bounds", i + (step - 1)), step).otherwise(0)

    cell = F.lit(0)
    step = BALANCED // 2
    while step:  # binary search for the number of bounds at or below the value
        cell = let(cell, search(step))
        step //= 2
    return df.withColumn("_bounds", bounds).withColumn(out, cell).drop("_bounds")


def number_rows(df: DataFrame, key: str, out: str, cells: int = 1024) -> DataFrame:
    """Dense numbers from 0, the same on every run: by cells of the key's hash and by the key inside. ``key`` is unique.

    Cells are counted, their offsets added up over the counts, and rows numbered inside; no task sees more than a cell.
    """
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(key), F.lit(cells)))
    counts = cut.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))  # at most ``cells`` rows
    offsets = counts.select("_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1)
    return ranked.join(F.broadcast(offsets), "_cell").select(*df.columns, (F.col("_before") + F.col("_rank")).alias(out))


def index_within(
    df: DataFrame,
    keys: Sequence[str],
    coarse: Sequence[str],
    split: str,
    ties: Sequence[str] = (),
    out: str = "idx",
    values: DataFrame | None = None,
) -> DataFrame:
    """0-based position by ``coarse + [split] + ties`` inside each ``keys`` group.

    A group is cut along its own order: by the coarse columns (few values) and by ranges of
    the numeric ``split`` column (:func:`with_balanced_cell`). Positions are counted inside the cells, and the cells' offsets
    come from a running sum over their counts, so no task ever holds a whole group. ``values`` may
    name a cheaper table that covers the range of ``split``, such as the one it comes from.
    """
    cut = with_balanced_cell(df, df if values is None else values, split)
    cell = [*keys, *coarse, "_cell"]
    counts = cut.groupBy(*cell).agg(F.count("*").alias("_n"))
    running = (
        Window.partitionBy(*keys)
        .orderBy(*coarse, "_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    inside = Window.partitionBy(*cell).orderBy(split, *ties)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.alias("r").join(
        offsets.alias("o"), [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in cell]
    )
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("o._before") + F.col("r._rank")).alias(out)
    )


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each task's share to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
