"""One row to many."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.operators import expand as E
from duskboard.plans.registry import TODAY, query
from duskboard.sources.views import Tables


@query("expand_weekly", """
SELECT e.event_id, e.title, d.start_date, 'weekly-' || strftime(d.start_date, '%Y-%m-%d') || '-' || e.event_id AS external_id
FROM f_event e JOIN (SELECT CAST(DATE '2024-01-25' + CAST(i AS INT) AS DATE) AS start_date FROM range(14) AS r(i)) d
  ON isodow(d.start_date) = isodow(e.start_date) WHERE e.recurrence_hint IS NOT NULL AND month(d.start_date) <> 2""")
def expand_weekly(t: Tables) -> DataFrame:
    template = t.event.filter("recurrence_hint IS NOT NULL").select("event_id", "title", F.weekday("start_date").alias("weekday"))
    rows = E.expand_weekly(template, dt.date(2024, 1, 25), 14, skip_months=[2])
    return rows.select("event_id", "title", "start_date", F.concat_ws("-", F.lit("weekly"), F.date_format("start_date", "yyyy-MM-dd"), "event_id").alias("external_id"))


@query("expand_showtimes", """
SELECT event_id, unnest(CASE WHEN len(start_times) > 0 THEN start_times ELSE [start_time] END) AS start_time,
  CAST(unnest(range(greatest(len(start_times), 1))) AS BIGINT) AS session_pos FROM f_event""")
def expand_showtimes(t: Tables) -> DataFrame:
    return E.expand_showtimes(t.event.select("event_id", "start_time", "start_times")).select(
        "event_id", "start_time", F.col("session_pos").cast("bigint").alias("session_pos"))


@query("expand_date_range", """
SELECT DISTINCT event_id, d AS day FROM (
  SELECT event_id, unnest([CAST(start_date + CAST(i AS INT) AS DATE) for i in range(coalesce(end_date, start_date) - start_date + 1)]) AS d FROM f_event
  UNION ALL SELECT event_id, CAST(start_date + 9 AS DATE) FROM f_event WHERE price = 'free')""")
def expand_date_range(t: Tables) -> DataFrame:
    extras = F.array(F.when(F.col("price") == "free", F.date_add("start_date", 9)))
    return E.expand_dates(t.event.withColumn("extras", extras), "start_date", "end_date", "extras", out="day").select("event_id", "day")


@query("explode_sessions", """
SELECT o_orderkey, o_orderstatus AS status, i AS session_no, CAST(o_orderdate AS DATE) + CAST(7 * i AS INT) AS session_date
FROM orders, range(1, 5) AS r(i) WHERE i <= o_orderkey % 5 AND i <> 2""")
def explode_sessions(t: Tables) -> DataFrame:
    """Orders as shows with up to four weekly sessions; the second one lacks its number."""
    none = F.array().cast("array<struct<session_no:bigint,session_date:date>>")
    weeks = F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 5)
    sessions = F.transform(weeks, lambda i: F.struct(
        F.when(i != 2, i).alias("session_no"), F.date_add(F.col("o_orderdate").cast("date"), (7 * i).cast("int")).alias("session_date")))
    shows = t.orders.withColumn("sessions", F.when(F.col("o_orderkey") % 5 > 0, sessions).otherwise(none))
    return E.explode_sessions(shows, "sessions", "session_no").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), "session.session_no", "session.session_date")


@query("range_fallback", """
SELECT o_orderkey, CAST(l_shipdate AS DATE) AS session_date, 'session' AS kind FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 'range' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def range_fallback(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return E.join_with_fallback(
        t.orders, t.lineitem, F.col("l_orderkey") == key, "l_orderkey",
        session=[key, F.col("l_shipdate").cast("date"), F.lit("session")],
        alone=[key, F.col("o_orderdate").cast("date").alias("session_date"), F.lit("range").alias("kind")])


@query("week_starts", """
SELECT event_id, CAST(i AS INT) AS week_no, CAST(date_trunc('week', start_date) AS DATE) + CAST(7 * i AS INT) AS week_start FROM f_event, range(6) AS r(i)""")
def week_starts(t: Tables) -> DataFrame:
    return E.week_starts(t.event.select("event_id", "start_date"), "start_date", 6).select("event_id", "week_no", "week_start")
