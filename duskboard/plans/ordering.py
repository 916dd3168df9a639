"""Order-dependent operators: picks, fills, positions and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions import categories as C
from duskboard.functions.dates import MONTH_PATTERN, month_number
from duskboard.functions.text import capital_count, film_key, strip_bracket_suffix
from duskboard.operators import agenda as G
from duskboard.operators import ranking as K
from duskboard.operators import sequences as S
from duskboard.operators.rules import upcoming
from duskboard.operators.films import film_groups
from duskboard.plans.registry import NOW, NOW_EARLY, TODAY, query
from duskboard.plans.reports import PAGES_SQL, pages_of
from duskboard.sources.views import Tables

DAY_ORDER_SQL = "time_key, start_date, coalesce(est, ''), event_id, sp"


@query("dedupe_keep_first", """
SELECT venue_slug, source_url, title, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY venue_slug, source_url ORDER BY event_id) AS rn FROM f_event) WHERE rn = 1""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    rows = t.event.select("venue_slug", "source_url", "title", "event_id")
    return K.keep_first(rows, ["venue_slug", "source_url"], ["event_id"])


@query("last_write_wins", """
SELECT venue_slug, title, start_date, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY venue_slug, title, start_date ORDER BY pos DESC) AS rn FROM f_batch) WHERE rn = 1""")
def last_write_wins(t: Tables) -> DataFrame:
    return K.keep_last(t.batch.select("venue_slug", "title", "start_date", "pos"), ["venue_slug", "title", "start_date"], ["pos"])


@query("month_rollover", """
WITH a AS (SELECT conv_id, turn, 1 + length(text) % 31 AS day FROM conversations),
b AS (SELECT *, CASE WHEN day < lag(day) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS w FROM a),
c AS (SELECT *, CAST(DATE '2024-11-01' + to_months(CAST(sum(w) OVER (PARTITION BY conv_id ORDER BY turn) AS INT)) AS DATE) AS first FROM b)
SELECT conv_id, turn, CASE WHEN month(first + CAST(day - 1 AS INT)) = month(first) THEN first + CAST(day - 1 AS INT) END AS date FROM c""")
def month_rollover(t: Tables) -> DataFrame:
    import datetime as dt

    lines = t.conversations.select("conv_id", "turn", (1 + F.length("text") % 31).alias("day"), F.lit(dt.date(2024, 11, 1)).alias("opening"))
    return S.roll_months(lines, "opening", "day", "conv_id", "turn").select("conv_id", "turn", "date")


@query("forward_fill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations""")
def forward_fill(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.md5(F.col("text").cast("binary"))).alias("header"))
    return S.forward_fill(lines, "header", "conv_id", "turn")


@query("backward_fill", """
WITH tok AS (SELECT event_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM (
  SELECT event_id, regexp_extract_all(lower(raw), '([0-9]+|[a-zç]+)', 1) AS ts FROM f_date_text)),
m AS (SELECT tok.*, f_month.month AS mo FROM tok LEFT JOIN f_month ON token IN (f_month.ca, f_month.es, f_month.en)),
u AS (SELECT DISTINCT event_id, pos, token, mo FROM m),
f AS (SELECT *, first_value(mo IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_month FROM u)
SELECT event_id, CAST(pos AS BIGINT) AS pos, CAST(token AS INT) AS day, next_month FROM f WHERE regexp_matches(token, '^[0-9]{1,2}$')""")
def backward_fill(t: Tables) -> DataFrame:
    """Each day number of a printed date takes the month named after it."""
    tokens = t.date_text.select("event_id", F.posexplode(
        F.regexp_extract_all(F.lower("raw"), F.lit("([0-9]+|[a-zç]+)"), F.lit(1))).alias("pos", "token"))
    named = tokens.withColumn("next_month", F.when(F.col("token").rlike(f"^({MONTH_PATTERN})$"), month_number("token")))
    filled = S.backward_fill(named, ["next_month"], "event_id", "pos")
    return filled.filter(F.col("token").rlike("^[0-9]{1,2}$")).select(
        "event_id", F.col("pos").cast("bigint").alias("pos"), F.col("token").cast("int").alias("day"), "next_month")


@query("display_title", r"""
WITH a AS (SELECT event_id, title, trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS bare FROM f_event),
b AS (SELECT *, lower(bare) AS film_key, length(regexp_replace(title, '[^\p{Lu}]', '', 'g')) AS caps, length(regexp_replace(bare, '[^\p{Lu}]', '', 'g')) AS bare_caps FROM a)
SELECT film_key, count(*) AS n, CASE WHEN min(lower(title)) = max(lower(title)) THEN arg_min(title, caps * 10000000000 + event_id)
  ELSE arg_min(bare, bare_caps * 10000000000 + event_id) END AS title FROM b GROUP BY film_key""")
def display_title(t: Tables) -> DataFrame:
    bare = strip_bracket_suffix("title")
    g = t.event.groupBy(film_key("title").alias("film_key")).agg(
        F.count("*").alias("n"), (F.min(F.lower("title")) == F.max(F.lower("title"))).alias("same"),
        F.min_by("title", F.struct(capital_count("title").alias("c"), "event_id")).alias("full"),
        F.min_by(bare, F.struct(capital_count(bare).alias("c"), "event_id")).alias("bare"))
    return g.select("film_key", "n", F.when(F.col("same"), F.col("full")).otherwise(F.col("bare")).alias("title"))


@query("row_index_in_day", "WITH " + PAGES_SQL + f"""
SELECT locale, list_slug, logical_date, event_id, sp AS session_pos,
  row_number() OVER (PARTITION BY locale, list_slug, logical_date ORDER BY {DAY_ORDER_SQL}) - 1 AS row_index FROM pages_rows""")
def row_index_in_day(t: Tables) -> DataFrame:
    rows = G.with_row_index(pages_of(t), ["locale", "list_slug"], t.events)
    return rows.select("locale", "list_slug", "logical_date", "event_id", F.col("session_pos").cast("bigint").alias("session_pos"), "row_index")


EARLY_SQL = "WITH " + PAGES_SQL + """
, moments AS (SELECT * FROM (VALUES ('evening', '119:10', DATE '2024-01-15'), ('dawn', '204:10', DATE '2024-01-15')) AS v(moment, cut, today)),
f AS (SELECT moment, p.*, logical_date = today AND time_key < cut AS early FROM pages_rows p, moments),
g AS (SELECT *, sum(CASE WHEN early THEN 1 ELSE 0 END) OVER w AS n_early, count(*) OVER w AS n_day FROM f
  WINDOW w AS (PARTITION BY moment, locale, list_slug, logical_date))
SELECT moment, locale, list_slug, logical_date, event_id, sp AS session_pos, early AND n_early > 0 AND n_early < n_day AS hidden FROM g"""


@query("early_hidden", EARLY_SQL)
def early_hidden(t: Tables) -> DataFrame:
    pages, by = pages_of(t), ["locale", "list_slug"]

    def at(moment, now):
        return G.early_hidden(pages, now, by).select(
            F.lit(moment).alias("moment"), *by, "logical_date", "event_id", F.col("session_pos").cast("bigint").alias("session_pos"), "hidden")

    return at("evening", NOW).unionByName(at("dawn", NOW_EARLY))


@query("now_marker", "WITH " + PAGES_SQL + r"""
, k AS (SELECT *, lower(trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', ''))) AS film_key FROM pages_rows WHERE logical_date = DATE '2024-01-15'),
d AS (SELECT locale, list_slug, '' AS film_key, count(*) AS n, count(*) FILTER (time_key <= '121:10') AS gone FROM k GROUP BY locale, list_slug),
f AS (SELECT locale, list_slug, film_key, count(*) AS n, count(*) FILTER (time_key <= '121:10') AS gone FROM k GROUP BY locale, list_slug, film_key)
SELECT 'day' AS level, locale, list_slug, film_key, gone AS marker_row, gone = n AS all_past FROM d
UNION ALL SELECT 'film', locale, list_slug, film_key, CASE WHEN gone = n THEN n - 1 ELSE gone END, gone = n FROM f""")
def now_marker(t: Tables) -> DataFrame:
    pages, by = pages_of(t), ["locale", "list_slug"]
    day = G.now_marker(pages, NOW, by).select(F.lit("day").alias("level"), *by, F.lit("").alias("film_key"), "marker_row", "all_past")
    film = G.film_now_marker(pages, NOW, film_key("title"), by).select(F.lit("film").alias("level"), *by, "film_key", "marker_row", "all_past")
    return day.unionByName(film)


@query("first_visible_day", "WITH " + PAGES_SQL + """
SELECT locale, list_slug, min(logical_date) AS first_day FROM pages_rows WHERE logical_date >= DATE '2024-01-15' GROUP BY ALL""")
def first_visible_day(t: Tables) -> DataFrame:
    return G.first_visible_day(pages_of(t), NOW, ["locale", "list_slug"])


# A source's ordered category rules.
RULES = [(["PROMO"], "dance"), (["LARGE", "Brand#7"], "kids"), (["SMALL"], "pop")]


@query("first_matching_rule", """
SELECT event_id, CASE WHEN list_contains(annotations, 'PROMO') THEN 'dance' WHEN list_has_any(annotations, ['LARGE', 'Brand#7']) THEN 'kids'
  WHEN list_contains(annotations, 'SMALL') THEN 'pop' ELSE 'classical' END AS category FROM f_event""")
def first_matching_rule(t: Tables) -> DataFrame:
    return t.event.select("event_id", C.first_matching_rule("annotations", RULES, "classical").alias("category"))


@query("sort_agenda_py", """
SELECT event_id, start_date, coalesce(start_time, '00:00') AS shown_time FROM f_event WHERE start_date >= DATE '2024-01-15' ORDER BY start_date, shown_time, event_id""")
def sort_agenda_py(t: Tables) -> DataFrame:
    return G.order_agenda(upcoming(t.event, TODAY), "min").select("event_id", "start_date", F.coalesce("start_time", F.lit("00:00")).alias("shown_time"))


@query("sort_agenda_sql", """
SELECT event_id, start_date, start_time FROM f_event WHERE start_date >= DATE '2024-01-14' ORDER BY start_date, start_time NULLS FIRST, event_id""")
def sort_agenda_sql(t: Tables) -> DataFrame:
    return G.order_agenda(upcoming(t.event, TODAY, lookback=1), "first").select("event_id", "start_date", "start_time")


@query("logical_day_sort", "WITH " + PAGES_SQL + f"""
SELECT locale, list_slug, logical_date, time_key, event_id, sp AS session_pos FROM pages_rows ORDER BY logical_date, {DAY_ORDER_SQL}""")
def logical_day_sort(t: Tables) -> DataFrame:
    return G.order_logical(pages_of(t)).select("locale", "list_slug", "logical_date", "time_key", "event_id", F.col("session_pos").cast("bigint").alias("session_pos"))


@query("list_priority", """
SELECT slug, p IS NOT NULL AS "primary" FROM f_list LEFT JOIN (VALUES ('jazz', 1), ('classical', 2), ('theater', 3), ('film', 4), ('dance', 5)) AS o(s, p) ON s = slug
WHERE author = 'house' ORDER BY coalesce(p, 99), slug""")
def list_priority(t: Tables) -> DataFrame:
    return G.order_lists(t.list)


@query("category_order", """
SELECT event_id, array_to_string(list_concat([x for x in u if x = 'theater'], [x for x in list_sort(u) if x <> 'theater']), '|') AS ordered
FROM (SELECT event_id, list_distinct([category, 'jazz', CASE WHEN recurrence_hint IS NOT NULL THEN 'theater' ELSE 'kids' END]) AS u FROM f_event)""")
def category_order(t: Tables) -> DataFrame:
    third = F.when(F.col("recurrence_hint").isNotNull(), F.lit("theater")).otherwise(F.lit("kids"))
    return t.event.select("event_id", F.array_join(C.order_categories(F.array("category", F.lit("jazz"), third)), "|").alias("ordered"))


@query("first_n_per_venue", """
SELECT venue_slug, event_id, title FROM (SELECT *, row_number() OVER (PARTITION BY venue_slug ORDER BY event_id) AS rn FROM f_event) WHERE rn <= 5""")
def first_n_per_venue(t: Tables) -> DataFrame:
    return K.first_n(t.event, ["venue_slug"], ["event_id"], 5).select("venue_slug", "event_id", "title")
