"""One row to many: weekly templates, showtimes, date ranges, sessions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_weekly(
    template: DataFrame, today: dt.date, days: int, skip_months: Sequence[int] = (), weekday: str = "weekday"
) -> DataFrame:
    """Template rows on each of the next ``days`` days that fall on their weekday (Monday is 0).

    Every template row generates its own dates, so nothing is joined or shuffled.
    """
    span = F.sequence(F.lit(today), F.lit(today + dt.timedelta(days=days - 1)))
    skipped = F.array(*[F.lit(m) for m in skip_months]).cast("array<int>")
    dates = F.filter(
        span, lambda d: (F.weekday(d) == F.col(weekday)) & ~F.array_contains(skipped, F.month(d))
    )
    return template.withColumn("start_date", F.explode(dates))


def expand_showtimes(df: DataFrame, times: str = "start_times", time: str = "start_time") -> DataFrame:
    """One row per session with its position; a row without any time stays, once, timeless."""
    sessions = F.when(F.size(times) > 0, F.col(times)).otherwise(F.array(F.col(time)))
    rest = [c for c in df.columns if c not in (times, time)]
    return df.select(*rest, F.col(time).alias("event_start_time"), F.posexplode(sessions).alias("session_pos", "_t")).select(
        *rest, "event_start_time", "session_pos", F.substring("_t", 1, 5).alias(time)
    )


def expand_dates(
    df: DataFrame, start: str, end: str, extras: str | None = None, out: str = "start_date"
) -> DataFrame:
    """One row per day of a range and per extra day; rows without a usable range are dropped."""
    last = F.coalesce(F.col(end), F.col(start))
    span = F.when(F.col(start) <= last, F.sequence(F.col(start), last)).otherwise(
        F.array().cast("array<date>")
    )
    days = span if extras is None else F.array_union(span, F.array_compact(F.col(extras)))
    return df.withColumn(out, F.explode(days))


def explode_sessions(
    df: DataFrame, path: Column | str, session_id: str | None = None, alias: str = "session"
) -> DataFrame:
    """Parent rows to session rows; a session without its id is dropped."""
    sessions = F.col(path) if isinstance(path, str) else path
    out = df.withColumn(alias, F.explode(sessions))
    if session_id is not None:
        out = out.filter(F.col(f"{alias}.{session_id}").isNotNull())
    return out


def with_fallback(sessions: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Sessions, plus one row for every parent that has none."""
    missing = parents.join(sessions.select(key).distinct(), key, "left_anti")
    return sessions.unionByName(missing, allowMissingColumns=True)


def join_with_fallback(parents: DataFrame, sessions: DataFrame, on: Column, has: str, session: Sequence[Column], alone: Sequence[Column]) -> DataFrame:
    """:func:`with_fallback` for sessions that are found by joining their parents: the columns ``session`` of every pair,
    and ``alone`` of every parent without one, from a single join. ``has`` is a column of the sessions that ``on`` compares,
    so it is null where there is none."""
    joined = parents.join(sessions, on, "left")
    return joined.select(*[F.when(F.col(has).isNotNull(), s).otherwise(a).alias(n) for s, a, n in zip(session, alone, joined.select(*alone).columns, strict=True)])


def week_starts(df: DataFrame, date: str, weeks: int, out: str = "week_start") -> DataFrame:
    """The Mondays of the row's week and the following ones."""
    monday = F.trunc(F.col(date), "week")
    return df.withColumn("week_no", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))).withColumn(
        out, F.date_add(monday, F.col("week_no") * 7)
    )


def union_staged(*frames: DataFrame) -> DataFrame:
    """One staging table from several producers; absent columns become nulls."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
