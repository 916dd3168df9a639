"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions.dates import logical_date, time_sort_key
from duskboard.operators import aggregates as A
from duskboard.operators.agenda import all_pages, day_counts
from duskboard.operators.films import film_groups
from duskboard.operators.joins import page_keys
from duskboard.plans.registry import TODAY, query
from duskboard.sources.views import Tables

# Rows of every (list, day) page in the source language, as SQL; shared by several checks.
PAGES_SQL = """
hits AS (
  SELECT DISTINCT l.slug AS list_slug, e.event_id, e.start_date, e.start_time AS est, e.start_times, e.price, v.name AS venue_name, e.title AS raw_title, e.source_url AS raw_url
  FROM f_list l JOIN f_list_venue lv ON lv.list_id = l.list_id JOIN f_venue v ON v.venue_id = lv.venue_id JOIN f_event e ON e.venue_id = v.venue_id
  WHERE l.author = 'house' AND e.start_date >= DATE '2024-01-14'
    AND (lv.whitelist_category_id IS NULL OR EXISTS (SELECT 1 FROM f_event_category ec WHERE ec.event_id = e.event_id AND ec.category_id = lv.whitelist_category_id))),
local AS (
  SELECT h.*, lo.locale, coalesce(t.title, raw_title) AS title, coalesce(t.source_url, raw_url) AS source_url
  FROM hits h CROSS JOIN (VALUES ('ca'), ('es'), ('en')) AS lo(locale) LEFT JOIN f_translation t ON t.event_id = h.event_id AND t.lang = lo.locale),
sessions AS (
  SELECT *, unnest(CASE WHEN len(start_times) > 0 THEN start_times ELSE [est] END) AS start_time,
    unnest(range(greatest(len(start_times), 1))) AS session_pos FROM local),
dated AS (
  SELECT *, CASE WHEN start_time < '05:00' THEN CAST(start_date - INTERVAL 1 DAY AS DATE) ELSE start_date END AS logical_date,
    CASE WHEN start_time IS NULL THEN '0' WHEN start_time >= '05:00' THEN '1' || start_time ELSE '2' || start_time END AS time_key FROM sessions),
pages_rows AS (SELECT *, CAST(session_pos AS BIGINT) AS sp FROM dated WHERE logical_date >= DATE '2024-01-15')
"""


def pages_of(t: Tables) -> DataFrame:
    return all_pages(t.list, t.list_venue, t.venue, t.event, t.event_category, t.translation, TODAY)


@query("field_coverage", """
SELECT venue_slug, count(*) AS n, """ + ", ".join(
    f"count(*) FILTER ({c}) AS with_{f}, (100 * count(*) FILTER ({c})) // count(*) AS pct_{f}"
    for f, c in {"start_time": "start_time IS NOT NULL", "price": "price IS NOT NULL", "image_url": "image_url IS NOT NULL",
                 "annotations": "len(annotations) > 0", "external_id": "external_id IS NOT NULL"}.items())
    + " FROM f_batch GROUP BY venue_slug")
def field_coverage(t: Tables) -> DataFrame:
    return A.coverage(t.batch)


@query("category_histogram", "SELECT category, count(*) AS n FROM (SELECT unnest(category_slugs) AS category FROM f_batch) GROUP BY category")
def category_histogram(t: Tables) -> DataFrame:
    return A.category_counts(t.batch)


@query("duplicate_ids", """
SELECT venue_slug, count(*) - count(DISTINCT external_id) AS dupes,
  count(DISTINCT CASE WHEN n > 1 THEN external_id END) AS clashing_ids
FROM (SELECT venue_slug, external_id, count(external_id) OVER (PARTITION BY venue_slug, external_id) AS n FROM f_batch) GROUP BY venue_slug""")
def duplicate_ids(t: Tables) -> DataFrame:
    return A.duplicate_ids(t.batch)


@query("run_report", """
WITH r AS (SELECT venue_slug, pos, CASE WHEN external_id LIKE 'dup-%' THEN 'ValueError: ' || external_id WHEN category_slugs[1] = 'poetry' THEN 'ValueError: poetry' END AS error FROM f_batch)
SELECT venue_slug, count(error) = 0 AS ok, CASE WHEN count(error) = 0 THEN count(*) ELSE 0 END AS n_events,
  arg_min(error, pos) FILTER (error IS NOT NULL) AS first_error FROM r GROUP BY venue_slug""")
def run_report(t: Tables) -> DataFrame:
    error = F.when(F.startswith("external_id", F.lit("dup-")), F.concat(F.lit("ValueError: "), "external_id")).when(
        F.element_at("category_slugs", 1) == "poetry", F.lit("ValueError: poetry"))
    return A.run_report(t.batch.select("venue_slug", "pos", error.alias("error")))


@query("film_groups", r"""
WITH e AS (SELECT *, CASE WHEN start_time < '05:00' THEN CAST(start_date - INTERVAL 1 DAY AS DATE) ELSE start_date END AS logical_date,
    CASE WHEN start_time IS NULL THEN '0' WHEN start_time >= '05:00' THEN '1' || start_time ELSE '2' || start_time END AS time_key,
    trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS bare FROM f_event),
r AS (SELECT *, lower(bare) AS film_key, row_number() OVER (PARTITION BY logical_date, lower(bare) ORDER BY time_key, start_date, event_id) AS seen,
    length(regexp_replace(title, '[^\p{Lu}]', '', 'g')) AS caps, length(regexp_replace(bare, '[^\p{Lu}]', '', 'g')) AS bare_caps FROM e)
SELECT logical_date, film_key,
  CASE WHEN count(DISTINCT lower(title)) = 1 THEN arg_min(title, caps * 1000000 + seen) ELSE arg_min(bare, bare_caps * 1000000 + seen) END AS title,
  count(*) AS n_showtimes, min(time_key) AS earliest_key, arg_max(coalesce(start_time, ''), seen) AS latest_time, arg_min(event_id, seen) AS first_event
FROM r GROUP BY logical_date, film_key""")
def film_groups_query(t: Tables) -> DataFrame:
    agenda = t.event.select(
        "event_id", "title", "start_date", "start_time", F.col("start_time").alias("event_start_time"), F.lit(0).alias("session_pos"),
        logical_date("start_date", "start_time").alias("logical_date"), time_sort_key("start_time").alias("time_key"))
    return film_groups(agenda).select("logical_date", "film_key", "title", "n_showtimes", "earliest_key", "latest_time",
                                      F.col("first_seen.event_id").alias("first_event"))


@query("hour_profile", """
SELECT o.offset_hours, (h + o.offset_hours) % 24 AS hour, count(*) AS n
FROM (SELECT hour(ts) AS h FROM events), (VALUES (0), (1), (2)) AS o(offset_hours) GROUP BY ALL""")
def hour_profile(t: Tables) -> DataFrame:
    return A.hour_profile(t.events, F.hour("ts"), [0, 1, 2])


@query("day_buckets", "WITH " + PAGES_SQL + """
SELECT locale, list_slug, logical_date, count(*) AS n, min(time_key) AS first_key, max(time_key) AS last_key FROM pages_rows GROUP BY ALL""")
def day_buckets(t: Tables) -> DataFrame:
    return day_counts(pages_of(t), ["locale", "list_slug"])


@query("list_summary", "WITH " + PAGES_SQL + """
, n AS (SELECT locale, list_slug, count(*) AS n FROM pages_rows GROUP BY ALL)
SELECT k.locale, l.slug AS list_slug, coalesce(n.n, 0) AS n, n.n IS NULL AS is_empty
FROM f_list l CROSS JOIN (VALUES ('ca'), ('es'), ('en')) AS k(locale) LEFT JOIN n ON n.locale = k.locale AND n.list_slug = l.slug WHERE l.author = 'house'""")
def list_summary(t: Tables) -> DataFrame:
    return A.list_summary(pages_of(t), page_keys(t.list, ["ca", "es", "en"]))
