"""Greedy column packing of a day's cards, for days of any size.

The rule is sequential: a card's place depends on all cards before it. But only the differences of the columns' heights
matter for the choice of a column, and whatever they are at first, a few cards make them alike. So a day is cut into
consecutive chunks, and each chunk becomes a function from the differences it may begin with to those it ends with,
found for all of them at once, in parallel. The functions are composed from the day's first card on, which gives every
chunk its beginning, and all chunks are then placed in parallel. Days of one chunk go the same way.

A column that is higher than a chunk can reach takes no card, so it is one and the same beginning however high it is.
Beginnings between the differences in the table and that are rare: they follow a card higher than all cards of the
table's range. Each of them is looked up by folding its chunk once more, for all days together.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskboard.operators.ranking import index_within
from duskboard.session import stored

#: Cards of a chunk, and beginnings in its table; they change the plan's grain, never the result.
CHUNK, BEGINNINGS = 20_000, 4096
FAR = 1 << 40


def place(heights: Sequence[int], start: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Columns, rows and final column heights of cards laid one by one."""
    tops = [int(x) for x in start]
    cols, rows = [], []
    for h in heights:
        c = tops.index(min(tops))
        cols.append(c)
        rows.append(tops[c])
        tops[c] += int(h) + 1
    return cols, rows, tops


def beginnings(k: int, most: int = BEGINNINGS) -> tuple[int, dict[tuple[int, ...], int]]:
    """(largest difference, number of each beginning): the heights above the lowest column, up to that difference or FAR."""
    reach = 0
    while (reach + 3) ** k - (reach + 2) ** k <= most and reach < most:
        reach += 1
    steps = [*range(reach + 1), FAR]
    return reach, {x: i for i, x in enumerate(v for v in itertools.product(steps, repeat=k) if min(v) == 0)}


def transition(heights: Sequence[int], k: int, most: int = BEGINNINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, which, rise): the distinct ends above their lowest column; and for every beginning the number of its end,
    and by how much the lowest column rose. FAR columns stay FAR above the old lowest column, so fall by the rise."""
    tops = np.array(list(beginnings(k, most)[1]), np.int64).reshape(-1, k)
    which, rise = np.arange(len(tops)), np.zeros(len(tops), np.int64)

    def merged() -> None:
        nonlocal tops, which, rise
        low = tops.min(axis=1)
        rise = rise + low[which]
        tops, place_of = np.unique(np.where(tops >= FAR // 2, FAR, tops - low[:, None]), axis=0, return_inverse=True)
        which = place_of.reshape(-1)[which]

    for i, h in enumerate(heights):
        c = tops.argmin(axis=1)  # the leftmost of equal ones
        tops[np.arange(len(tops)), c] += int(h) + 1
        if i % 16 == 15:
            merged()
    merged()
    return tops, which, rise


def follow(start: Sequence[int], total: int, numbers: dict[tuple[int, ...], int], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int] | None:
    """The heights after a chunk that begins at ``start``; none where its table does not hold the beginning. ``total`` is
    the height of all its cards with their gutters."""
    low = min(start)
    seen = tuple(FAR if x - low > total else x - low for x in start)
    number = numbers.get(seen)
    if number is None:
        return None
    ends, which, rise = table
    end, up = ends[which[number]], low + int(rise[number])
    return [s if f == FAR else up + int(e) for s, f, e in zip(start, seen, end, strict=True)]


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the further columns of ``right``; a null key, as of an undated day, is a key."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *(f"r.{c}" for c in right.columns if c not in left.columns))


def _tables(cards: DataFrame, keys: list[str], ks: Sequence[int], most: int) -> DataFrame:
    """The function of every chunk but a day's first, for every ``k``; and the height of its cards."""
    named = {f.name: f.dataType for f in cards.schema.fields}
    schema = T.StructType([T.StructField(c, named[c]) for c in [*keys, "_chunk"]] + [
        T.StructField("k", T.IntegerType()), T.StructField("_total", T.LongType()),
        *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("_ends", "_which", "_rise")),
    ])

    def run(chunk: pa.Table) -> pa.Table:
        heights = chunk.column("height").to_numpy()[np.argsort(chunk.column("_idx").to_numpy(), kind="stable")]
        rows = {c: chunk.column(c).slice(0, 1).to_pylist() * len(ks) for c in [*keys, "_chunk"]}
        found = [transition(heights, k, most) for k in ks]
        rows |= {"k": list(ks), "_total": [int(heights.sum() + len(heights))] * len(ks)}
        rows |= {c: [t[i].reshape(-1) for t in found] for i, c in enumerate(("_ends", "_which", "_rise"))}
        types = [chunk.schema.field(c).type for c in [*keys, "_chunk"]] + [pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 3
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return cards.select(*keys, "_chunk", "_idx", "height").groupBy(*keys, "_chunk").applyInArrow(run, schema)


def _starts(cards: DataFrame, keys: list[str], ks: Sequence[int], most: int) -> DataFrame:
    """(keys, k, _chunk, _start): the heights every chunk begins with."""
    days = [*keys, "k"]
    every = F.explode(F.array(*map(F.lit, ks))).alias("k")
    chunks = cards.select(*keys, "_chunk").distinct().select(*keys, "_chunk", every)
    later = cards.filter("_chunk > 0")
    # The first chunk begins at zero; what it ends with is folded, not looked up.
    schema = T.StructType([cards.schema[c] for c in keys] + [T.StructField("k", T.IntegerType()), T.StructField("_chunk", T.LongType()), T.StructField("_from", T.ArrayType(T.LongType())), T.StructField("_to", T.ArrayType(T.LongType()))])

    def fold(key: tuple, chunk: pa.Table) -> pa.Table:
        heights = chunk.column("height").to_numpy()[np.argsort(chunk.column("_idx").to_numpy(), kind="stable")].tolist()
        begins = {(k, tuple(b)) for k, b in zip(chunk.column("k").to_pylist(), chunk.column("_from").to_pylist(), strict=True)}
        (k, begin), = begins
        rows = {c: chunk.column(c).slice(0, 1) for c in [*keys, "k", "_chunk"]}
        rows |= {"_from": pa.array([list(begin)], pa.list_(pa.int64())), "_to": pa.array([place(heights, begin)[2]], pa.list_(pa.int64()))}
        return pa.table(rows)

    def folded(wanted: DataFrame) -> DataFrame:
        """The ends of single chunks from given beginnings (keys, k, _chunk, _from)."""
        own = _joined(cards.select(*keys, "_chunk", "_idx", "height"), wanted, [*keys, "_chunk"])
        return own.select(*keys, "k", "_chunk", "_from", "_idx", "height").groupBy(*keys, "k", "_chunk").applyInArrow(fold, schema)

    long_days = stored(later.select(*keys).distinct(), "days")
    if long_days.isEmpty():
        return chunks.select(*days, "_chunk", F.array_repeat(F.lit(0).cast("long"), F.col("k")).alias("_start"))
    zero = F.array_repeat(F.lit(0).cast("long"), F.col("k"))
    first = long_days.select(*keys, every, F.lit(0).cast("long").alias("_chunk")).withColumn("_from", zero)
    tables = stored(_tables(later, keys, ks, most), "tables")
    known = stored(folded(first), "folded")
    while True:
        composed = stored(_composed(tables, known, keys, most), "composed")
        stuck = composed.filter("NOT _known").select(*days, "_chunk", F.col("_start").alias("_from"))
        if stuck.isEmpty():
            break
        known = stored(known.unionByName(folded(stuck)), "folded")
    found = composed.select(*days, "_chunk", "_start")
    return _joined(chunks, found, [*days, "_chunk"], "left").withColumn("_start", F.coalesce("_start", zero))


def _composed(tables: DataFrame, known: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The beginnings of a day's chunks, one after another as far as they are known. A day's tables pass through one task
    sorted, one at a time: a few hundred numbers for a chunk of cards."""
    days = [*keys, "k"]
    side = ["_total", "_ends", "_which", "_rise", "_from", "_to"]
    both = known.withColumns({c: F.lit(None).cast(tables.schema[c].dataType) for c in side[:4]}).unionByName(
        tables.withColumns({c: F.lit(None).cast(known.schema[c].dataType) for c in side[4:]}))
    schema = T.StructType([known.schema[c] for c in days] + [T.StructField("_chunk", T.LongType()), T.StructField("_start", T.ArrayType(T.LongType())), T.StructField("_known", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(r[c] for c in days), r) for b in batches for r in b.to_pylist())
        numbers: dict[int, dict] = {}
        for day, own in itertools.groupby(rows, key=lambda r: r[0]):
            k, state, out = day[-1], None, []
            folds: dict[tuple, list[int]] = {}
            stuck = False
            numbers.setdefault(k, beginnings(k, most)[1])
            for _, r in own:
                if r["_from"] is not None:  # folded chunks come before the table of the same chunk
                    folds[r["_chunk"], tuple(r["_from"])] = r["_to"]
                    if r["_chunk"] == 0:
                        state = r["_to"]
                    continue
                if stuck:
                    continue
                end = folds.get((r["_chunk"], tuple(state)))
                if end is None:
                    table = np.array(r["_ends"], np.int64).reshape(-1, k), np.array(r["_which"]), np.array(r["_rise"])
                    end = follow(state, r["_total"], numbers[k], table)
                out.append((*day, r["_chunk"], state, end is not None))
                stuck, state = end is None, end
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    ordered = both.repartition(*days).sortWithinPartitions(*days, "_chunk", F.col("_from").isNull())
    return ordered.mapInArrow(run, schema)


def pack(
    films: DataFrame,
    ks: Sequence[int],
    keys: Sequence[str],
    order: Sequence[str],
    split: str,
    ties: Sequence[str] = (),
    values: DataFrame | None = None,
    chunk: int = CHUNK,
    most: int = BEGINNINGS,
) -> DataFrame:
    """One row per film and column count ``k`` with the card's ``col`` and ``row`` (both 0-based).

    ``order``, ``split`` and ``ties`` are the films' order as :func:`index_within` takes it. The cards are stored once
    and the beginnings of their chunks found when this is called.
    """
    keys, ks = list(keys), list(ks)
    indexed = index_within(films, keys, order, split, ties, out="_idx", values=values)
    cards = stored(indexed.select("*", F.floor(F.col("_idx") / chunk).cast("long").alias("_chunk")), "cards")
    starts = _starts(cards, keys, ks, most)
    cell = [*keys, "k", "_chunk"]
    schema = T.StructType(
        cards.schema.fields + [T.StructField("k", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("row", T.LongType())])

    def fold(cards: pa.Table) -> pa.Table:
        cards = cards.take(np.argsort(cards.column("_idx").to_numpy(), kind="stable"))
        cols, rows, _ = place(cards.column("height").to_pylist(), cards.column("_start")[0].as_py())
        return cards.drop_columns(["_start"]).append_column("col", pa.array(cols, pa.int32())).append_column("row", pa.array(rows, pa.int64()))

    laid = _joined(cards, starts, [*keys, "_chunk"]).select(*cards.columns, "k", "_start").groupBy(*cell).applyInArrow(fold, schema)
    return laid.select(*films.columns, "k", "col", "row")


def total_rows(packed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Grid rows a packed day takes up: the end of its lowest card."""
    return packed.groupBy(*by).agg(F.max(F.col("row") + F.col("height")).alias("total_rows"))
