"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskboard.functions.categories import LOCALES
from duskboard.operators.agenda import all_pages
from duskboard.plans.registry import TODAY, query
from duskboard.plans.reports import PAGES_SQL
from duskboard.plans.digests import ABSENT, SOURCES, digests, sql_digests
from duskboard.sources.entities import read_entity, read_pages
from duskboard.sources.feeds import Field, explode_entries, parse_documents, parse_feed, read_fields
from duskboard.session import new_folder
from duskboard.sources.sinks import publish
from duskboard.sources.snapshots import read_events, write_events
from duskboard.sources.views import Tables


@query("scan_entities", sql_digests(dict.fromkeys(SOURCES, "true")))
def scan_entities(t: Tables) -> DataFrame:
    """Stores every entity and reads it with its declared schema."""
    path = new_folder(t.spark, "entities")
    for name, view in SOURCES.items():
        t.view(view).write.parquet(f"{path}/{name}")
    tables = {name: read_entity(t.spark, path, name) for name in SOURCES}
    return digests({name: df.drop(*ABSENT.get(name, ())) for name, df in tables.items()})


@query("scan_pages", "SELECT page_id, url, length(html) AS n_chars, md5(html) AS digest FROM pages")
def scan_pages(t: Tables) -> DataFrame:
    pages = read_pages(t.spark, f"{t.folder}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.md5(F.col("html").cast("binary")).alias("digest"))


@query("scan_json_feed", """
SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, props ->> '$.missing' AS missing FROM events
""")
def scan_json_feed(t: Tables) -> DataFrame:
    feed = parse_feed(t.events.select("event_id", "props"), "props", "k int, missing string")
    return feed.select("event_id", "feed.k", "feed.missing")


@query("scan_changing_feed", """
SELECT event_id, entry_pos, entry_id, begins, hidden, CAST(NULL AS VARCHAR) AS reason FROM (
  SELECT event_id, CAST(i - 1 AS BIGINT) AS entry_pos, CASE WHEN event_id % 5 <> 0 THEN 's' || i END AS entry_id, start_times[i] AS begins, event_id % 5 <> 0 AND i = 2 AS hidden
  FROM (SELECT event_id, start_times, unnest(range(1, len(start_times) + 1)) AS i FROM f_event WHERE event_id % 11 NOT IN (4, 5) AND event_id % 5 NOT IN (1, 2)))
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, CASE WHEN event_id % 11 = 5 THEN 'no text' ELSE 'not JSON' END FROM f_event WHERE event_id % 11 IN (4, 5)""")
def scan_changing_feed(t: Tables) -> DataFrame:
    """Sessions of documents that list them or key them by id, and the documents that cannot be read."""
    good, broken = parse_documents(t.feed, "doc")
    sessions = read_fields(explode_entries(good, "document", "$.sessions"), "entry", {"begins": Field("text", ("$.at",)), "hidden": Field("flag", ("$.hidden",))})
    sessions = sessions.withColumn("entry_pos", F.col("entry_pos").cast("long"))
    return sessions.unionByName(broken.select("event_id", "reason"), allowMissingColumns=True)


#: All columns of an event, arrays as text.
EVENT_SQL = """event_id, venue_id, venue_slug, external_id, title, start_date, start_time, array_to_string(start_times, ',') AS start_times, end_date,
  end_time, {price} AS price, description, image_url, source_url, recurrence_hint, array_to_string(annotations, ',') AS annotations, category"""


def flat(events: DataFrame) -> DataFrame:
    return events.withColumns({c: F.array_join(c, ",") for c in ("start_times", "annotations")})


@query("sink_events", f"""
SELECT 1 AS version, {EVENT_SQL.format(price="price")} FROM f_event
UNION ALL SELECT 2, {EVENT_SQL.format(price="CASE WHEN venue_id % 7 = 2 THEN 'free' ELSE price END")} FROM f_event WHERE venue_id % 7 <> 3""")
def sink_events(t: Tables) -> DataFrame:
    """Writes all venues, then some venues' changed rows and others without rows; a reader of the first version stays with it."""
    path = new_folder(t.spark, "events")
    first = write_events(t.event, path)
    before = read_events(t.spark, path, t.event.schema)
    changed = t.event.filter("venue_id % 7 = 2").withColumn("price", F.lit("free"))
    replaced = t.event.filter("venue_id % 7 IN (2, 3)").select("venue_slug")
    second = write_events(changed, path, replaced)
    after = read_events(t.spark, path, t.event.schema)
    return flat(before).select(F.lit(first).alias("version"), "*").unionByName(flat(after).select(F.lit(second).alias("version"), "*"))


@query("publish_agenda", "WITH " + PAGES_SQL + """
SELECT locale, list_slug, logical_date, time_key, event_id, sp AS session_pos, title, start_time, venue_name, price, source_url FROM pages_rows""")
def publish_agenda(t: Tables) -> DataFrame:
    pages = all_pages(t.list, t.list_venue, t.venue, t.event, t.event_category, t.translation, TODAY, LOCALES)
    path = new_folder(t.spark, "agenda")
    publish(pages, path, "parquet")
    stored = t.spark.read.schema(pages.schema).parquet(path)
    columns = ("locale", "list_slug", "logical_date", "time_key", "event_id", "session_pos", "title", "start_time", "venue_name", "price", "source_url")
    return stored.withColumn("session_pos", F.col("session_pos").cast("long")).select(*columns)
