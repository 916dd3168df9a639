"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions.text import normalize_url
from duskboard.operators import joins as J
from duskboard.plans.registry import query
from duskboard.plans.scalars import slug
from duskboard.sources.views import Tables


@query("list_events", """
SELECT DISTINCT l.slug AS list_slug, e.event_id, e.title, e.start_date, v.name AS venue_name
FROM f_list l JOIN f_list_venue lv ON lv.list_id = l.list_id JOIN f_venue v ON v.venue_id = lv.venue_id JOIN f_event e ON e.venue_id = v.venue_id
WHERE lv.whitelist_category_id IS NULL OR EXISTS (
  SELECT 1 FROM f_event_category ec WHERE ec.event_id = e.event_id AND ec.category_id = lv.whitelist_category_id)""")
def list_events(t: Tables) -> DataFrame:
    hits = J.list_events(t.list, t.list_venue, t.venue, t.event, t.event_category)
    return hits.select("list_slug", "event_id", "title", "start_date", "venue_name")


@query("whitelist_filter", """
SELECT DISTINCT lv.list_id, e.event_id FROM f_list_venue lv JOIN f_event e ON e.venue_id = lv.venue_id
WHERE lv.whitelist_category_id IS NULL OR EXISTS (
  SELECT 1 FROM f_event_category ec WHERE ec.event_id = e.event_id AND ec.category_id = lv.whitelist_category_id)""")
def whitelist_filter(t: Tables) -> DataFrame:
    return J.whitelist(t.event.select("event_id", "venue_id"), t.list_venue, t.event_category).select("list_id", "event_id")


@query("distinct_events", """
SELECT event_id, count(DISTINCT list_id) AS n_lists FROM (
  SELECT lv.list_id, e.event_id FROM f_list_venue lv JOIN f_event e ON e.venue_id = lv.venue_id
  WHERE lv.whitelist_category_id IS NULL OR EXISTS (
    SELECT 1 FROM f_event_category ec WHERE ec.event_id = e.event_id AND ec.category_id = lv.whitelist_category_id)) GROUP BY event_id""")
def distinct_events(t: Tables) -> DataFrame:
    """Rows per event after overlapping memberships have collapsed: one for each list."""
    hits = J.list_events(t.list, t.list_venue, t.venue, t.event.select("event_id", "venue_id"), t.event_category)
    return hits.groupBy("event_id").agg(F.count("*").alias("n_lists"))


@query("translation_join", """
SELECT e.event_id, coalesce(t.title, e.title) AS title, coalesce(t.source_url, e.source_url) AS source_url
FROM f_event e LEFT JOIN f_translation t ON t.event_id = e.event_id AND t.lang = 'es'""")
def translation_join(t: Tables) -> DataFrame:
    return J.localize(t.event.select("event_id", "title", "source_url"), t.translation, "es")


@query("enrich_from_detail", """
WITH d AS (SELECT * FROM (SELECT source_url, description, price, title, row_number() OVER (PARTITION BY source_url
    ORDER BY CAST(price IS NULL AS INT) + CAST(description IS NULL AS INT) + CAST(title IS NULL AS INT),
      price NULLS FIRST, description NULLS FIRST, title NULLS FIRST) AS rn FROM f_event) WHERE rn = 1)
SELECT e.event_id, coalesce(e.price, d.price) AS price, coalesce(d.description, e.description) AS description, coalesce(e.title, d.title) AS title
FROM f_event e LEFT JOIN d ON d.source_url = e.source_url""")
def enrich_from_detail(t: Tables) -> DataFrame:
    detail = t.event.select("source_url", "description", "price", "title")
    out = J.enrich(t.event, detail, "source_url", {"price": "listing", "description": "detail", "title": "listing"})
    return out.select("event_id", "price", "description", "title")


@query("session_production_join", """
SELECT l.l_orderkey AS session_order, l.l_linenumber AS session_no, o.o_orderstatus AS status,
  array_to_string([x for x in [a.p_name, b.p_name, CAST(NULL AS VARCHAR), c.p_name] if x IS NOT NULL], '|') AS titles
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
LEFT JOIN part a ON a.p_partkey = l.l_partkey LEFT JOIN part b ON b.p_partkey = l.l_suppkey LEFT JOIN part c ON c.p_partkey = l.l_linenumber""")
def session_production_join(t: Tables) -> DataFrame:
    sessions = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.array("l_partkey", "l_suppkey", F.lit(-1).cast("long"), F.col("l_linenumber").cast("long")).alias("ids"))
    out = J.resolve_ids(sessions, "k", "ids", t.part, "p_partkey", "p_name", "titles", longest=4)
    return out.select(F.col("k.l_orderkey").alias("session_order"), F.col("k.l_linenumber").alias("session_no"),
                      "status", F.array_join("titles", "|").alias("titles"))


@query("slug_join", f"""
WITH idx AS (SELECT {slug('p_name')} AS s, min(p_brand) AS brand FROM part GROUP BY 1)
SELECT e.event_id, coalesce(idx.brand, 'default') AS brand FROM f_event e LEFT JOIN idx ON idx.s = {slug('e.title')}""")
def slug_join(t: Tables) -> DataFrame:
    index = t.part.select("p_name", F.col("p_brand").alias("brand"))
    return J.slug_join(t.event.select("event_id", "title"), "title", index, "p_name", {"brand": F.lit("default")}).select("event_id", "brand")


@query("slot_join", """
WITH o AS (SELECT venue_id, start_date, start_time, title, source_url, event_id FROM f_event WHERE start_time IS NOT NULL),
f AS (SELECT venue_id, start_date, start_time, arg_min(title, event_id) AS title, arg_min(source_url, event_id) AS url FROM o GROUP BY ALL)
SELECT e.event_id, CASE WHEN f.title <> e.title THEN 'en' END AS lang, CASE WHEN f.title <> e.title THEN f.title END AS other_title,
  CASE WHEN f.title <> e.title THEN f.url END AS other_url
FROM f_event e LEFT JOIN f ON f.venue_id = e.venue_id AND f.start_date = e.start_date AND f.start_time = e.start_time""")
def slot_join(t: Tables) -> DataFrame:
    slot = ["venue_id", "start_date", "start_time"]
    other = t.event.filter("start_time IS NOT NULL").select(*slot, "title", "source_url", "event_id")
    return J.slot_join(t.event.select("event_id", "title", *slot), other, slot, "event_id", "en").select(
        "event_id", "lang", "other_title", "other_url")


@query("weekday_price", """
SELECT event_id, ['7€','7€','7€','7€','7€','9€','9€'][isodow(start_date)] AS weekend, ['6€','6€','6€','4€','6€','8€','8€'][isodow(start_date)] AS viewer_day,
  ['5,90€','7,50€',NULL,'7,50€','8€','9€','9€'][isodow(start_date)] AS per_day FROM f_event""")
def weekday_price(t: Tables) -> DataFrame:
    per_day = ["5,90€", "7,50€", None, "7,50€", "8€", "9€"]
    return t.event.select("event_id", *[J.weekday_price("start_date", p).alias(n) for n, p in J.WEEKDAY_PRICES.items()],
                          J.weekday_price("start_date", per_day).alias("per_day"))


@query("default_price", """
SELECT e.event_id, coalesce(e.price, CASE WHEN v.address IS NOT NULL THEN length(v.name) || '€' END) AS price
FROM f_event e JOIN f_venue v ON v.venue_id = e.venue_id""")
def default_price(t: Tables) -> DataFrame:
    dim = t.venue.select("venue_id", F.when(F.col("address").isNotNull(), F.concat(F.length("name").cast("string"), F.lit("€"))).alias("price"))
    return J.with_default(t.event.select("event_id", "venue_id", "price"), dim, "venue_id", "price").select("event_id", "price")


@query("mandatory_time_join", """
SELECT e.event_id, d.start_time FROM f_event e JOIN (
  SELECT regexp_replace(split_part(source_url, '?', 1), '/+$', '') AS u, min(start_time) AS start_time FROM f_translation JOIN (SELECT event_id AS eid, start_time FROM f_event) x ON eid = event_id
  WHERE source_url IS NOT NULL GROUP BY 1) d ON d.u = e.source_url""")
def mandatory_time_join(t: Tables) -> DataFrame:
    times = t.translation.filter("source_url IS NOT NULL").join(t.event.select("event_id", "start_time"), "event_id")
    detail = times.select(normalize_url("source_url").alias("u"), "start_time")
    cards = t.event.select("event_id", normalize_url("source_url").alias("u"))
    return J.enrich(cards, detail, "u", {"start_time": "detail"}, how="inner").select("event_id", "start_time")


@query("unknown_categories", """
SELECT DISTINCT b.venue_slug, u.slug FROM f_batch b, unnest(b.category_slugs) AS u(slug) WHERE u.slug NOT IN (SELECT slug FROM f_category)""")
def unknown_categories(t: Tables) -> DataFrame:
    return J.unknown_categories(t.batch, t.category).select("venue_slug", "slug")


@query("locale_list_cross", """
SELECT l.locale, f.slug AS list_slug FROM f_list f, (VALUES ('ca'), ('es'), ('en')) AS l(locale) WHERE f.author = 'house'""")
def locale_list_cross(t: Tables) -> DataFrame:
    return J.page_keys(t.list, ["ca", "es", "en"])
