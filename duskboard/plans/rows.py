"""Filters, projections and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions import categories as C
from duskboard.functions import dates as D
from duskboard.operators import joins as J
from duskboard.operators import rules as R
from duskboard.operators.expand import union_staged
from duskboard.operators.merge import stale_translations
from duskboard.plans.registry import LOCALE, TODAY, query
from duskboard.sources.views import Tables


@query("venues_in_category", """
SELECT 'category' AS asked, v.slug, true AS known FROM f_venue v WHERE EXISTS (
  SELECT 1 FROM f_venue_category vc JOIN f_category c ON c.category_id = vc.category_id WHERE vc.venue_id = v.venue_id AND c.slug = 'jazz')
UNION ALL SELECT 'all', slug, true FROM f_venue
UNION ALL SELECT 'named', w.slug, v.slug IS NOT NULL FROM (VALUES ('venue-1'), ('venue-4'), ('nowhere')) AS w(slug) LEFT JOIN f_venue v ON v.slug = w.slug""")
def venues_in_category(t: Tables) -> DataFrame:
    vc = (
        t.venue_category.join(t.category.select("category_id", F.col("slug").alias("category_slug")), "category_id")
        .join(t.venue.select("venue_id", F.col("slug").alias("venue_slug")), "venue_id")
        .select("venue_slug", "category_slug")
    )

    def tag(df, asked):
        return df.select(F.lit(asked).alias("asked"), "slug", "known")

    return (
        tag(R.select_venues(t.venue, vc, category="jazz"), "category")
        .unionByName(tag(R.select_venues(t.venue, vc), "all"))
        .unionByName(tag(R.select_venues(t.venue, vc, slugs=["venue-1", "venue-4", "nowhere"]), "named"))
    )


@query("upcoming_filter", "SELECT event_id, start_date FROM f_event WHERE start_date >= DATE '2024-01-15'")
def upcoming_filter(t: Tables) -> DataFrame:
    return R.upcoming(t.event, TODAY).select("event_id", "start_date")


@query("lookback_filter", "SELECT event_id, start_date FROM f_event WHERE start_date >= DATE '2024-01-14'")
def lookback_filter(t: Tables) -> DataFrame:
    return R.upcoming(t.event, TODAY, lookback=1).select("event_id", "start_date")


@query("day_floor", """
SELECT event_id, logical_date FROM (
  SELECT event_id, CASE WHEN start_time < '05:00' THEN CAST(start_date - INTERVAL 1 DAY AS DATE) ELSE start_date END AS logical_date FROM f_event)
WHERE logical_date >= DATE '2024-01-15'""")
def day_floor(t: Tables) -> DataFrame:
    return R.day_floor(t.event.select("event_id", D.logical_date("start_date", "start_time").alias("logical_date")), TODAY)


@query("horizon_filter", """
SELECT 'ahead' AS side, event_id FROM f_event WHERE start_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-22'
UNION ALL SELECT 'published', o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-01-01' - 548""")
def horizon_filter(t: Tables) -> DataFrame:
    import datetime as dt

    ahead = R.within(t.event, "start_date", TODAY, ahead=7).select(F.lit("ahead").alias("side"), "event_id")
    published = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("published"))
    recent = R.within(published, "published", dt.date(2000, 1, 1), behind=548)
    return ahead.unionByName(recent.select(F.lit("published").alias("side"), F.col("o_orderkey").alias("event_id")))


@query("require_fields", """
SELECT event_id FROM f_event WHERE trim(coalesce(description, '')) <> '' AND start_time IS NOT NULL AND image_url IS NOT NULL""")
def require_fields(t: Tables) -> DataFrame:
    return R.require(t.event, "description", "start_time", "image_url").select("event_id")


DENY = [
    R.Rule("exact", "title", "Red Widget"), R.Rule("prefix", "title", "hot "), R.Rule("regex", "title", "bolt.*\\(vose\\)"),
    R.Rule("contains", "text", "sold-out"), R.Rule("contains", "source_url", "/e/1"),
]


@query("exclude_rules", r"""
SELECT event_id FROM f_event WHERE lower(trim(title)) <> 'red widget' AND lower(title) NOT LIKE 'hot %'
  AND NOT regexp_matches(lower(title), 'bolt.*\(vose\)') AND coalesce(price, '') <> 'sold-out'
  AND source_url NOT LIKE '%/e/1%' AND recurrence_hint IS NULL""")
def exclude_rules(t: Tables) -> DataFrame:
    df = t.event.withColumn("text", F.concat_ws(" ", "title", "price")).withColumn("hidden", F.col("recurrence_hint").isNotNull())
    return R.exclude(df, DENY, flags=["hidden"]).select("event_id")


@query("include_rules", r"""
SELECT event_id FROM f_event WHERE regexp_matches(lower(title), '\b(ring|gear)') OR annotations[1] = 'PROMO'""")
def include_rules(t: Tables) -> DataFrame:
    df = t.event.withColumn("kind", F.try_element_at("annotations", F.lit(1)))
    return R.include(df, [R.Rule("regex", "title", "\\b(ring|gear)"), R.Rule("exact", "kind", "promo")]).select("event_id")


@query("localize_content", """
SELECT e.event_id, l.lang AS locale, coalesce(t.title, e.title) AS title, coalesce(t.source_url, e.source_url) AS source_url
FROM f_event e CROSS JOIN (VALUES ('es'), ('en'), ('ca')) AS l(lang)
LEFT JOIN f_translation t ON t.event_id = e.event_id AND t.lang = l.lang""")
def localize_content(t: Tables) -> DataFrame:
    return J.localize_all(t.event.select("event_id", "title", "source_url"), t.translation, ["es", "en", "ca"]).select(
        "event_id", "locale", "title", "source_url")


@query("display_price", """
WITH p AS (SELECT * FROM (VALUES ('ca', 'free', 'Gratuït'), ('ca', 'sold-out', 'Exhaurit'), ('es', 'free', 'Gratis'),
  ('es', 'sold-out', 'Agotado'), ('en', 'free', 'Free'), ('en', 'sold-out', 'Sold out')) AS v(locale, price, label))
SELECT event_id, l.locale, coalesce(p.label, e.price, '') AS shown
FROM f_event e CROSS JOIN (VALUES ('ca'), ('es'), ('en')) AS l(locale) LEFT JOIN p ON p.locale = l.locale AND p.price = e.price""")
def display_price(t: Tables) -> DataFrame:
    df = t.event.select("event_id", "price", F.explode(F.array(*[F.lit(x) for x in C.LOCALES])).alias("locale"))
    return df.select("event_id", "locale", C.display_price("price", "locale").alias("shown"))


@query("category_label", """
SELECT event_id, l.locale, coalesce(n.label, s.slug) AS label
FROM (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'opera' ELSE category END AS slug FROM f_event) s
CROSS JOIN (VALUES ('ca'), ('es'), ('en')) AS l(locale)
LEFT JOIN (VALUES ('ca', 'film', 'Cinema'), ('ca', 'jazz', 'Jazz'), ('ca', 'classical', 'Clàssica'), ('ca', 'theater', 'Teatre'), ('ca', 'club', 'Club'),
  ('es', 'film', 'Cine'), ('es', 'jazz', 'Jazz'), ('es', 'classical', 'Clásica'), ('es', 'theater', 'Teatro'), ('es', 'club', 'Club'),
  ('en', 'film', 'Film'), ('en', 'jazz', 'Jazz'), ('en', 'classical', 'Classical'), ('en', 'theater', 'Theater'), ('en', 'club', 'Club')) AS n(locale, slug, label)
  ON n.locale = l.locale AND n.slug = s.slug""")
def category_label(t: Tables) -> DataFrame:
    slug = F.when(F.col("event_id") % 10 == 9, F.lit("opera")).otherwise(F.col("category"))
    df = t.event.select("event_id", slug.alias("slug"), F.explode(F.array(*[F.lit(x) for x in C.LOCALES])).alias("locale"))
    return df.select("event_id", "locale", C.category_name("slug", "locale").alias("label"))


@query("day_heading", """
WITH d AS (SELECT event_id, start_date AS day, isodow(start_date) AS w, CAST(month(start_date) AS INT) AS m, CAST(day(start_date) AS VARCHAR) AS n FROM f_event)
SELECT event_id, l.locale,
  CASE l.locale
    WHEN 'ca' THEN ['dilluns','dimarts','dimecres','dijous','divendres','dissabte','diumenge'][w] || ', ' || n || ' ' || ['de gener','de febrer'][m]
    WHEN 'es' THEN ['lunes','martes','miércoles','jueves','viernes','sábado','domingo'][w] || ', ' || n || ' de ' || ['enero','febrero'][m]
    ELSE ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][w] || ' ' || n || ' ' || ['January','February'][m] END AS heading
FROM d CROSS JOIN (VALUES ('ca'), ('es'), ('en')) AS l(locale)""")
def day_heading(t: Tables) -> DataFrame:
    df = t.event.select("event_id", "start_date", F.explode(F.array(*[F.lit(x) for x in C.LOCALES])).alias("locale"))
    return df.select("event_id", "locale", D.day_heading("start_date", F.col("locale")).alias("heading"))


@query("union_sources", """
SELECT event_id AS pos, venue_slug, title, price, CAST(NULL AS VARCHAR) AS note FROM f_event
UNION ALL SELECT page_id, 'pages', url, NULL, 'page' FROM pages
UNION ALL SELECT pos, venue_slug, title, price, NULL FROM f_batch""")
def union_sources(t: Tables) -> DataFrame:
    pages = t.pages.select(F.col("page_id").alias("pos"), F.lit("pages").alias("venue_slug"), F.col("url").alias("title"), F.lit("page").alias("note"))
    return union_staged(t.event.select(F.col("event_id").alias("pos"), "venue_slug", "title", "price"), pages, t.batch.select("pos", "venue_slug", "title", "price"))


@query("stale_langs", """
SELECT t.event_id, t.lang FROM f_translation t JOIN f_event e ON e.event_id = t.event_id
WHERE NOT (t.lang = 'es' AND e.description IS NOT NULL AND e.price IS NOT NULL)""")
def stale_langs(t: Tables) -> DataFrame:
    fresh = t.event.select("event_id", F.filter(F.array(
        F.struct(F.lit("es").alias("lang"), F.when(F.col("description").isNotNull() & F.col("price").isNotNull(), F.col("title")).alias("title"))),
        lambda r: r["title"].isNotNull()).alias("translations"))
    return stale_translations(fresh, t.translation)


@query("label_intersection", """
SELECT event_id, coalesce(list_has_any(annotations, ['PROMO', 'Brand#7']), false) AS hit,
  CAST(len(list_intersect(annotations, ['PROMO', 'Brand#7'])) AS BIGINT) AS n_common FROM f_event""")
def label_intersection(t: Tables) -> DataFrame:
    wanted = ["PROMO", "Brand#7"]
    return t.event.select("event_id", C.any_label("annotations", wanted).alias("hit"),
                          F.size(F.array_intersect("annotations", F.array(*[F.lit(w) for w in wanted]))).cast("bigint").alias("n_common"))
