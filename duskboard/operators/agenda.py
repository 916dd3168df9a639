"""From events to agendas: every list, every language, day by day, at an instant."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.functions.categories import LOCALES
from duskboard.functions.dates import logical_date, time_sort_key
from duskboard.operators.expand import expand_showtimes
from duskboard.operators.joins import list_events, localize, localize_all
from duskboard.operators.ranking import index_within
from duskboard.operators.rules import day_floor, upcoming

#: Total order inside a day. The last four make positions reproducible.
DAY_ORDER = ["time_key", "start_date", "_est", "event_id", "session_pos"]
#: Lists shown first, in this order.
PRIMARY_LISTS = ["jazz", "classical", "theater", "film", "dance"]

_AGENDA_COLUMNS = [
    "event_id", "title", "start_date", "start_time", "venue_name", "price", "source_url",
    "recurrence_hint", "event_start_time", "session_pos",
]


def order_agenda(df: DataFrame, nulls: str = "first") -> DataFrame:
    """By date, time and id; a missing time counts as midnight (``min``) or comes first (``first``)."""
    time = F.coalesce("start_time", F.lit("00:00")) if nulls == "min" else F.col("start_time").asc_nulls_first()
    return df.orderBy("start_date", time, "event_id")


def order_logical(df: DataFrame) -> DataFrame:
    """By logical day and the order inside it."""
    return df.orderBy(
        "logical_date", "time_key", "start_date", F.col("event_start_time").asc_nulls_first(), "event_id", "session_pos"
    )


def order_lists(lists: DataFrame, author: str = "house") -> DataFrame:
    """House lists: the broad genres in fixed order, then the others by slug."""
    place = F.array_position(F.array(*[F.lit(s) for s in PRIMARY_LISTS]), F.col("slug"))
    return (
        lists.filter(F.col("author") == author)
        .select("slug", (place > 0).alias("primary"), F.when(place > 0, place).otherwise(99).alias("_place"))
        .orderBy("_place", "slug")
        .drop("_place")
    )


def list_agenda(
    lists: DataFrame,
    list_venues: DataFrame,
    venues: DataFrame,
    events: DataFrame,
    event_categories: DataFrame,
    translations: DataFrame,
    slug: str,
    locale: str,
    today: dt.date,
) -> DataFrame:
    """One list in one language: its events from yesterday on, a row per session."""
    fresh = upcoming(events, today, lookback=1)
    hits = list_events(lists, list_venues, venues, fresh, event_categories, slug)
    local = localize(hits, translations, locale)
    return expand_showtimes(local).select(*_AGENDA_COLUMNS)


def with_day(agenda: DataFrame) -> DataFrame:
    """Adds the logical day and the sort key inside it."""
    return agenda.withColumn("logical_date", logical_date("start_date", "start_time")).withColumn(
        "time_key", time_sort_key("start_time")
    )


def day_agenda(agenda: DataFrame, today: dt.date) -> DataFrame:
    """Agenda rows under their logical day, past days dropped."""
    return day_floor(with_day(agenda), today)


def all_pages(
    lists: DataFrame,
    list_venues: DataFrame,
    venues: DataFrame,
    events: DataFrame,
    event_categories: DataFrame,
    translations: DataFrame,
    today: dt.date,
    locales: Sequence[str] = LOCALES,
    author: str = "house",
) -> DataFrame:
    """Day agendas of every (locale, list) page in one job."""
    house = lists.filter(F.col("author") == author)
    fresh = upcoming(events, today, lookback=1)
    hits = list_events(house, list_venues, venues, fresh, event_categories)
    local = localize_all(hits, translations, locales)
    rows = expand_showtimes(local).select("locale", "list_slug", *_AGENDA_COLUMNS)
    return day_agenda(rows, today)


def day_counts(agenda: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events per logical day, with the day's first and last sort key."""
    return agenda.groupBy(*by, "logical_date").agg(
        F.count("*").alias("n"), F.min("time_key").alias("first_key"), F.max("time_key").alias("last_key")
    )


def with_row_index(agenda: DataFrame, by: Sequence[str] = (), events: DataFrame | None = None) -> DataFrame:
    """0-based row position inside each day (and page); ``events`` is where the ids come from."""
    est = agenda.withColumn("_est", F.coalesce("event_start_time", F.lit("")))
    return index_within(
        est, [*by, "logical_date"], ["time_key", "start_date", "_est"], "event_id", ["session_pos"],
        out="row_index", values=events,
    ).drop("_est")


def _clock(now: dt.datetime) -> tuple[dt.date, str, str]:
    """Logical today, key of now, key of two hours ago."""

    def key(t: str) -> str:
        return ("1" if t >= "05:00" else "2") + t

    hhmm = now.strftime("%H:%M")
    today = now.date() - dt.timedelta(days=1 if hhmm < "05:00" else 0)
    return today, key(hhmm), key((now - dt.timedelta(hours=2)).strftime("%H:%M"))


def early_hidden(agenda: DataFrame, now: dt.datetime, by: Sequence[str] = ()) -> DataFrame:
    """Flags today's leading rows that began over two hours ago.

    Rows of a day are in key order, so the leading run is exactly the rows below the cut; none
    is hidden when all of a day's rows (or no rows) are below it. The per-day counts are partial
    aggregates that are joined back.
    """
    today, _, cutoff = _clock(now)
    is_today = F.col("logical_date") == F.lit(today)
    early = F.col("time_key") < cutoff
    keys = [*by, "logical_date"]
    totals = (
        agenda.filter(is_today)
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.count_if(early).alias("_early"))
    )
    joined = agenda.join(totals, keys, "left")
    hide = is_today & early & (F.col("_early") > 0) & (F.col("_early") < F.col("_n"))
    return joined.withColumn("hidden", F.coalesce(hide, F.lit(False))).drop("_n", "_early")


def now_marker(agenda: DataFrame, now: dt.datetime, by: Sequence[str] = ()) -> DataFrame:
    """Row position of the now line in today's sections: before the first later row, else after the last."""
    today, key, _ = _clock(now)
    return (
        agenda.filter(F.col("logical_date") == F.lit(today))
        .groupBy(*by, "logical_date")
        .agg(
            F.count_if(F.col("time_key") <= key).alias("marker_row"),
            (F.count_if(F.col("time_key") > key) == 0).alias("all_past"),
        )
    )


def film_now_marker(agenda: DataFrame, now: dt.datetime, film: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per film of today: position of its next showtime, or of its last one, flagged as past."""
    today, key, _ = _clock(now)
    counts = (
        agenda.filter(F.col("logical_date") == F.lit(today))
        .groupBy(*by, "logical_date", film.alias("film_key"))
        .agg(F.count("*").alias("_n"), F.count_if(F.col("time_key") <= key).alias("_gone"))
    )
    past = F.col("_gone") == F.col("_n")
    return counts.select(
        *by, "logical_date", "film_key",
        F.when(past, F.col("_n") - 1).otherwise(F.col("_gone")).alias("marker_row"),
        past.alias("all_past"),
    )


def first_visible_day(agenda: DataFrame, now: dt.datetime, by: Sequence[str] = ()) -> DataFrame:
    """First day of each view that is not past."""
    today, _, _ = _clock(now)
    return agenda.filter(F.col("logical_date") >= F.lit(today)).groupBy(*by).agg(
        F.min("logical_date").alias("first_day")
    )


def agenda_as_of(agenda: DataFrame, now: dt.datetime, by: Sequence[str] = ()) -> DataFrame:
    """The agenda at an instant: past days gone, early rows flagged, first day marked."""
    today, key, _ = _clock(now)
    live = agenda.filter(F.col("logical_date") >= F.lit(today))
    flagged = early_hidden(live, now, by)
    first = first_visible_day(live, now, by)
    marked = flagged.join(first, list(by)) if by else flagged.withColumn("first_day", first.scalar())
    return marked.select(
        *agenda.columns,
        "hidden",
        (F.col("logical_date") == F.col("first_day")).alias("is_first_day"),
        ((F.col("logical_date") == F.lit(today)) & (F.col("time_key") <= key)).alias("started"),
    )
