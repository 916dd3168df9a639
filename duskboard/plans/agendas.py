"""Agendas: the composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.operators import agenda as G
from duskboard.operators.films import balance_columns, film_groups, order_films
from duskboard.plans.registry import LIST, LOCALE, NOW, TODAY, query
from duskboard.plans.reports import PAGES_SQL, pages_of
from duskboard.sources.views import Tables


def film_list(t: Tables) -> DataFrame:
    return G.list_agenda(t.list, t.list_venue, t.venue, t.event, t.event_category, t.translation, LIST, LOCALE, TODAY)


def bigint(name: str):
    return F.col(name).cast("bigint").alias(name)


@query("list_agenda", "WITH " + PAGES_SQL + """
SELECT event_id, title, start_date, start_time, venue_name, price, source_url, sp AS session_pos
FROM (SELECT *, CAST(session_pos AS BIGINT) AS sp FROM dated) WHERE list_slug = 'film' AND locale = 'ca'""")
def list_agenda(t: Tables) -> DataFrame:
    return G.order_agenda(film_list(t)).select(
        "event_id", "title", "start_date", "start_time", "venue_name", "price", "source_url", bigint("session_pos"))


@query("day_agenda", "WITH " + PAGES_SQL + """
SELECT logical_date, time_key, event_id, sp AS session_pos, title, start_time, venue_name, price, source_url FROM pages_rows WHERE list_slug = 'film' AND locale = 'ca'""")
def day_agenda(t: Tables) -> DataFrame:
    rows = G.order_logical(G.day_agenda(film_list(t), TODAY))
    return rows.select("logical_date", "time_key", "event_id", bigint("session_pos"), "title", "start_time", "venue_name", "price", "source_url")


FILMS_SQL = PAGES_SQL + r"""
, k AS (SELECT *, trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS bare FROM pages_rows),
r AS (SELECT *, lower(bare) AS film_key, row_number() OVER (PARTITION BY locale, list_slug, logical_date, lower(bare) ORDER BY time_key, start_date, coalesce(est, ''), event_id, sp) AS seen,
    length(regexp_replace(title, '[^\p{Lu}]', '', 'g')) AS caps, length(regexp_replace(bare, '[^\p{Lu}]', '', 'g')) AS bare_caps FROM k),
films AS (
  SELECT locale, list_slug, logical_date, film_key,
    CASE WHEN count(DISTINCT lower(title)) = 1 THEN arg_min(title, caps * 1000000 + seen) ELSE arg_min(bare, bare_caps * 1000000 + seen) END AS title,
    count(*) AS n_showtimes, count(*) + 1 AS height, min(time_key) AS earliest_key, arg_max(coalesce(start_time, ''), seen) AS latest_time,
    arg_min(start_date, seen) AS d1, arg_min(coalesce(est, ''), seen) AS e1, arg_min(event_id, seen) AS id1, arg_min(sp, seen) AS s1
  FROM r GROUP BY ALL)
"""


@query("film_day", "WITH " + FILMS_SQL + """
SELECT locale, list_slug, logical_date, film_key, title, n_showtimes, height, earliest_key, latest_time FROM films""")
def film_day(t: Tables) -> DataFrame:
    films = film_groups(pages_of(t), ["locale", "list_slug"])
    return films.select("locale", "list_slug", "logical_date", "film_key", "title", "n_showtimes", "height", "earliest_key", "latest_time")


@query("film_sort", "WITH " + FILMS_SQL + """
SELECT logical_date, film_key, earliest_key, id1 AS first_event FROM films WHERE list_slug = 'film' AND locale = 'ca' ORDER BY logical_date, earliest_key, d1, e1, id1, s1""")
def film_sort(t: Tables) -> DataFrame:
    films = film_groups(G.day_agenda(film_list(t), TODAY))
    return order_films(films).select("logical_date", "film_key", "earliest_key", F.col("first_seen.event_id").alias("first_event"))


@query("balance_columns", "WITH RECURSIVE " + FILMS_SQL + """
, o AS (SELECT locale, list_slug, logical_date, film_key, height, row_number() OVER (PARTITION BY locale, list_slug, logical_date ORDER BY earliest_key, d1, e1, id1, s1) AS i FROM films),
rec AS (
  SELECT k, locale, list_slug, logical_date, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS film_key, CAST(0 AS BIGINT) AS col, CAST(0 AS BIGINT) AS "row",
    [CAST(0 AS BIGINT) for z in range(k)] AS h FROM (SELECT DISTINCT locale, list_slug, logical_date FROM o), (VALUES (1), (2), (3)) AS ks(k)
  UNION ALL
  SELECT rec.k, rec.locale, rec.list_slug, rec.logical_date, o.i, o.film_key, CAST(list_position(h, list_min(h)) - 1 AS BIGINT), list_min(h),
    [CASE WHEN z = list_position(h, list_min(h)) THEN x + o.height + 1 ELSE x END for x, z in h]
  FROM rec JOIN o ON o.locale = rec.locale AND o.list_slug = rec.list_slug AND o.logical_date = rec.logical_date AND o.i = rec.i + 1)
SELECT CAST(k AS INT) AS k, locale, list_slug, logical_date, film_key, col, "row" FROM rec WHERE i > 0""")
def balance(t: Tables) -> DataFrame:
    by = ["locale", "list_slug"]
    placed = balance_columns(film_groups(pages_of(t), by), (1, 2, 3), by, t.events)
    return placed.select("k", *by, "logical_date", "film_key", bigint("col"), "row")


@query("agenda_as_of", "WITH " + PAGES_SQL + """
, g AS (SELECT *, logical_date = DATE '2024-01-15' AND time_key < '119:10' AS early, min(logical_date) OVER (PARTITION BY locale, list_slug) AS first_day FROM pages_rows),
h AS (SELECT *, sum(CASE WHEN early THEN 1 ELSE 0 END) OVER w AS n_early, count(*) OVER w AS n_day FROM g WINDOW w AS (PARTITION BY locale, list_slug, logical_date))
SELECT locale, list_slug, logical_date, event_id, sp AS session_pos, early AND n_early < n_day AS hidden, logical_date = first_day AS is_first_day,
  logical_date = DATE '2024-01-15' AND time_key <= '121:10' AS started FROM h""")
def agenda_as_of(t: Tables) -> DataFrame:
    by = ["locale", "list_slug"]
    return G.agenda_as_of(pages_of(t), NOW, by).select(*by, "logical_date", "event_id", bigint("session_pos"), "hidden", "is_first_day", "started")


@query("all_pages", "WITH " + PAGES_SQL + """
SELECT locale, list_slug, logical_date, time_key, event_id, sp AS session_pos, title, start_time, venue_name, price, source_url FROM pages_rows""")
def all_pages(t: Tables) -> DataFrame:
    return pages_of(t).select("locale", "list_slug", "logical_date", "time_key", "event_id", bigint("session_pos"), "title", "start_time",
                              "venue_name", "price", "source_url")
