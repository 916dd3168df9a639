"""Film view of a day: versions of a title merged, cards placed in balanced columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions.text import capital_count, film_key, strip_bracket_suffix
from duskboard.operators.packing import pack
from duskboard.operators.ranking import index_within


def _seen():
    """Order in which a day's rows are read; the first-seen rank of a title variant."""
    return F.struct(
        "time_key", "start_date", F.coalesce("event_start_time", F.lit("")).alias("est"), "event_id", "session_pos"
    )


def film_groups(agenda: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per day and film: display title, number of showtimes, earliest key, latest time.

    The title shown is the variant with the fewest capitals (first seen on ties), without its
    bracketed tag unless all variants share it. Everything is a partial aggregate; the showtimes
    themselves stay rows (:func:`film_showtimes`).
    """
    seen = _seen()
    bare = strip_bracket_suffix("title")
    grouped = agenda.groupBy(*by, "logical_date", film_key("title").alias("film_key")).agg(
        F.min(F.lower("title")).alias("_lo"),
        F.max(F.lower("title")).alias("_hi"),
        F.min_by("title", F.struct(capital_count("title").alias("n"), seen.alias("s"))).alias("_full"),
        F.min_by(bare, F.struct(capital_count(bare).alias("n"), seen.alias("s"))).alias("_bare"),
        F.count("*").alias("n_showtimes"),
        F.min("time_key").alias("earliest_key"),
        F.max_by(
            F.struct(F.coalesce("start_time", F.lit("")).alias("t")), F.struct(F.col("time_key"), seen.alias("s"))
        ).alias("_last"),
        F.min(seen).alias("first_seen"),
    )
    return grouped.select(
        *by, "logical_date", "film_key",
        F.when(F.col("_lo") == F.col("_hi"), F.col("_full")).otherwise(F.col("_bare")).alias("title"),
        "n_showtimes", "earliest_key", F.col("_last.t").alias("latest_time"), "first_seen",
        (F.col("n_showtimes") + 1).alias("height"),
    )


def film_showtimes(agenda: DataFrame, by: Sequence[str] = (), events: DataFrame | None = None) -> DataFrame:
    """The agenda's rows under their film, each with its 0-based position among the film's showtimes.

    Showtimes stay rows, so a film with very many is never gathered; ``events`` is where the ids
    come from.
    """
    rows = agenda.withColumn("film_key", film_key("title")).withColumn(
        "_est", F.coalesce("event_start_time", F.lit(""))
    )
    return index_within(
        rows, [*by, "logical_date", "film_key"], ["time_key", "start_date", "_est"], "event_id", ["session_pos"],
        out="showtime_no", values=events,
    ).drop("_est")


def order_films(films: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Films of a day by earliest showtime, first seen first."""
    return films.orderBy(*by, "logical_date", "earliest_key", "first_seen")


def balance_columns(
    films: DataFrame, ks: Sequence[int] = (3, 2, 1), by: Sequence[str] = (), events: DataFrame | None = None
) -> DataFrame:
    """Column and row of each film's card when a day's cards fill ``k`` columns, for every ``k``.

    Each card goes, in film order, to the column that is shortest so far, the leftmost on a tie,
    with one gutter row between cards. See :mod:`duskboard.operators.packing` for how days of any
    size are packed. ``events`` is where the event ids come from.
    """
    flat = films.select(
        *by, "logical_date", "film_key", "title", "height", "earliest_key",
        F.col("first_seen.start_date").alias("_d"), F.col("first_seen.est").alias("_e"),
        F.col("first_seen.event_id").alias("_id"), F.col("first_seen.session_pos").alias("_s"),
    )
    packed = pack(
        flat, ks, [*by, "logical_date"], ["earliest_key", "_d", "_e"], "_id", ["_s"],
        values=None if events is None else events.select(F.col("event_id").alias("_id")),
    )
    return packed.drop("_d", "_e", "_id", "_s")
