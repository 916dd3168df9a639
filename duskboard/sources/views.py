"""City-events entities projected from the given tables.

One text per view serves Spark and the SQL check alike. ``@name@`` marks the few spots
where the dialects differ. A view never drops rows of the table it is made from, except where
the entity itself is a partial child (translations, second categories).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_SPARK = {"str": "STRING", "arr": "array", "empty": "CAST(array() AS ARRAY<STRING>)"}
_DUCK = {"str": "VARCHAR", "arr": "list_value", "empty": "CAST([] AS VARCHAR[])"}

VIEWS: dict[str, str] = {}

VIEWS["f_city"] = """
SELECT CAST(r_regionkey AS BIGINT) AS city_id, replace(lower(r_name), ' ', '-') AS slug, r_name AS name
FROM region"""

VIEWS["f_category"] = """
SELECT CAST(category_id AS BIGINT) AS category_id, slug, name
FROM (VALUES (1, 'film', 'Film'), (2, 'jazz', 'Jazz'), (3, 'classical', 'Classical'),
             (4, 'theater', 'Theater'), (5, 'club', 'Club'), (6, 'flamenco', 'Flamenco'),
             (7, 'dance', 'Dance'), (8, 'kids', 'Kids'), (9, 'pop', 'Pop')) AS c(category_id, slug, name)"""

VIEWS["f_venue"] = """
SELECT s_suppkey AS venue_id, concat('venue-', CAST(s_suppkey AS @str@)) AS slug, s_name AS name,
       CAST(n_regionkey AS BIGINT) AS city_id,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat(n_name, ' ', CAST(s_suppkey AS @str@)) END AS address,
       concat('https://venue-', CAST(s_suppkey AS @str@), '.example.org') AS site_url
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

VIEWS["f_venue_category"] = """
SELECT s_suppkey AS venue_id, CAST(s_suppkey % 5 + 1 AS BIGINT) AS category_id FROM supplier
UNION ALL
SELECT s_suppkey AS venue_id, CAST((s_suppkey + 1) % 5 + 1 AS BIGINT) AS category_id
FROM supplier WHERE s_acctbal > 3000"""

# One row per dated occurrence. Title, venue and times all follow from the source row.
VIEWS["f_event"] = """
SELECT event_id, venue_id, concat('venue-', CAST(venue_id AS @str@)) AS venue_slug,
       CASE WHEN event_id % 20 = 3 THEN NULL ELSE concat('ev-', CAST(event_id AS @str@)) END AS external_id,
       CASE WHEN event_id % 4 = 0 THEN base
            WHEN event_id % 4 = 1 THEN upper(base)
            WHEN event_id % 4 = 2 THEN concat(base, ' (VOSE)')
            ELSE concat(upper(substr(base, 1, 1)), substr(base, 2), ' [VO]') END AS title,
       start_date,
       t1 AS start_time,
       CASE WHEN t1 IS NULL THEN @empty@
            WHEN event_id % 9 = 0 AND h < 21 THEN @arr@(t1, t2)
            ELSE @arr@(t1) END AS start_times,
       CASE WHEN p_size % 8 = 0 THEN CAST(start_date + INTERVAL 2 DAY AS DATE) END AS end_date,
       CAST(NULL AS @str@) AS end_time,
       CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 6 = 1 THEN 'free' WHEN event_id % 6 = 2 THEN 'sold-out'
            ELSE concat(CAST(5 + event_id % 40 AS @str@), '€') END AS price,
       CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(base, ' — ', p_type) END AS description,
       CASE WHEN event_id % 5 = 1 THEN NULL ELSE concat('https://img.example.org/', CAST(event_id AS @str@), '.jpg') END AS image_url,
       concat('https://venue-', CAST(venue_id AS @str@), '.example.org/e/', CAST(CAST(floor(event_id / 3) AS BIGINT) AS @str@)) AS source_url,
       CASE WHEN p_size % 10 = 0 THEN 'cada dilluns' END AS recurrence_hint,
       CASE WHEN p_size % 4 = 0 THEN @empty@ ELSE @arr@(p_type, p_brand) END AS annotations,
       category
FROM (
  SELECT event_id, venue_id, h, p_type, p_brand, p_size, category,
         replace(p_name, ' ', CASE WHEN p_size % 2 = 0 THEN ' i ' ELSE ' ' END) AS base,
         start_date,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat(lpad(CAST(h AS @str@), 2, '0'), CASE WHEN half = 1 THEN ':30' ELSE ':00' END) END AS t1,
         concat(lpad(CAST(h + 2 + half AS @str@), 2, '0'), CASE WHEN half = 1 THEN ':00' ELSE ':30' END) AS t2
  FROM (
    SELECT event_id, venue_id, h, half, start_date, category, p_name, p_type, p_brand, p_size
    FROM (
      SELECT event_id, user_id % (SELECT count(*) FROM supplier) AS venue_id,
             event_id % (SELECT count(*) FROM part) AS part_no, hour(ts) AS h,
             CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS half, CAST(ts AS DATE) AS start_date,
             CASE event_type WHEN 'click' THEN 'jazz' WHEN 'view' THEN 'film' WHEN 'purchase' THEN 'classical'
                             WHEN 'signup' THEN 'theater' ELSE 'club' END AS category
      FROM events
    ) AS e JOIN part ON p_partkey = part_no
  ) AS a
) AS b"""

VIEWS["f_event_category"] = """
SELECT event_id, c.category_id
FROM f_event JOIN f_category c ON c.slug = category
UNION ALL
SELECT event_id, CAST(8 AS BIGINT) AS category_id FROM f_event WHERE recurrence_hint IS NOT NULL"""

# Spanish where the event is described, English where it carries an image and a price.
VIEWS["f_translation"] = """
SELECT event_id, 'es' AS lang, concat('ES ', title) AS title, description,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat(source_url, '?lang=es') END AS source_url
FROM f_event WHERE description IS NOT NULL
UNION ALL
SELECT event_id, 'en' AS lang, concat('EN ', title) AS title, description,
       CASE WHEN event_id % 2 = 1 THEN NULL ELSE concat(source_url, '?lang=en') END AS source_url
FROM f_event WHERE image_url IS NOT NULL AND price IS NOT NULL"""

# House lists per category and per nation; a region's list is by another author and never published.
VIEWS["f_list"] = """
SELECT category_id AS list_id, slug, name, 'house' AS author, CAST(0 AS BIGINT) AS city_id FROM f_category
UNION ALL
SELECT CAST(200 + n_nationkey AS BIGINT) AS list_id, replace(lower(n_name), '_', '-') AS slug, n_name AS name, 'house' AS author,
       CAST(n_regionkey AS BIGINT) AS city_id FROM nation
UNION ALL
SELECT 100 + city_id AS list_id, concat('guest-', slug) AS slug, name, 'guest' AS author, city_id FROM f_city"""

# A venue of one category joins its list whole; others join once per category. Some venues sit in
# a list twice (whole and whitelisted), so overlapping memberships must collapse.
VIEWS["f_list_venue"] = """
SELECT vc.category_id AS list_id, vc.venue_id,
       CASE WHEN n.n_cat = 1 THEN CAST(NULL AS BIGINT) ELSE vc.category_id END AS whitelist_category_id
FROM f_venue_category vc
JOIN (SELECT venue_id, count(*) AS n_cat FROM f_venue_category GROUP BY venue_id) n ON n.venue_id = vc.venue_id
UNION ALL
SELECT CAST(venue_id % 5 + 1 AS BIGINT) AS list_id, venue_id, CAST(2 AS BIGINT) AS whitelist_category_id
FROM f_venue WHERE address IS NULL
UNION ALL
SELECT CAST(200 + s_nationkey AS BIGINT) AS list_id, s_suppkey AS venue_id, CAST(NULL AS BIGINT) AS whitelist_category_id FROM supplier
UNION ALL
SELECT 100 + city_id AS list_id, venue_id, CAST(NULL AS BIGINT) AS whitelist_category_id FROM f_venue"""

# A stored snapshot and a fresh batch over the same events. In the batch some ids are gone (URL and
# title tiers), some are new, some dates moved; a few venues are broken and must be quarantined.
VIEWS["f_current"] = """
SELECT event_id, venue_id, venue_slug,
       CASE WHEN event_id % 5 = 4 THEN NULL ELSE external_id END AS external_id,
       title, start_date, start_time, start_times, end_date, end_time, price, description, image_url,
       concat(source_url, '/', CAST(event_id AS @str@)) AS source_url, recurrence_hint, annotations, category
FROM f_event"""

VIEWS["f_batch"] = """
SELECT CASE WHEN venue_id = 7 THEN 'venue-unknown' ELSE venue_slug END AS venue_slug,
       event_id AS pos, title,
       CASE WHEN event_id % 6 = 0 THEN CAST(start_date + INTERVAL 7 DAY AS DATE) ELSE start_date END AS start_date,
       start_time, start_times, end_date, end_time,
       CASE WHEN event_id % 4 = 1 THEN 'sold-out' ELSE price END AS price, description, image_url,
       CASE WHEN event_id % 11 = 3 THEN concat(source_url, '/moved-', CAST(event_id AS @str@))
            ELSE concat(source_url, '/', CAST(event_id AS @str@)) END AS source_url,
       CASE WHEN venue_id = 3 THEN concat('dup-', CAST(event_id % 7 AS @str@))
            WHEN event_id % 20 = 3 OR event_id % 5 = 4 THEN NULL
            WHEN event_id % 20 = 7 THEN concat('new-', CAST(event_id AS @str@))
            ELSE external_id END AS external_id,
       recurrence_hint, annotations,
       CASE WHEN venue_id = 5 AND event_id % 4 = 0 THEN @arr@('poetry')
            WHEN recurrence_hint IS NOT NULL THEN @arr@(category, 'kids') ELSE @arr@(category) END AS category_slugs
FROM f_event"""

VIEWS["f_price_text"] = """
SELECT event_id, lo, hi,
  CASE event_id % 12
    WHEN 0 THEN NULL
    WHEN 1 THEN 'Entrada gratuïta'
    WHEN 2 THEN 'EXHAURIT'
    WHEN 3 THEN concat('De ', CAST(lo AS @str@), ' € a ', CAST(hi AS @str@), ' €')
    WHEN 4 THEN concat(CAST(lo AS @str@), ',50 €')
    WHEN 5 THEN concat('€', CAST(lo AS @str@), '-', CAST(hi AS @str@))
    WHEN 6 THEN 'per determinar'
    WHEN 7 THEN concat(CAST(lo AS @str@), ' euros ONLINE // ', CAST(hi AS @str@), ' euros TAQUILLA')
    WHEN 8 THEN concat(CAST(hi AS @str@), ' € | socis gratuït')
    WHEN 9 THEN 'Inclòs en el preu de l''entrada'
    WHEN 10 THEN concat('Sold out (', CAST(lo AS @str@), ' €)')
    ELSE concat('de ', CAST(lo AS @str@), ' a ', CAST(hi AS @str@), ' € (socis ', CAST(lo - 4 AS @str@), ' €)') END AS raw
FROM (SELECT event_id, 5 + event_id % 40 AS lo, 5 + event_id % 40 + event_id % 60 AS hi FROM f_event) AS a"""

VIEWS["f_time_text"] = """
SELECT event_id,
  CASE event_id % 9
    WHEN 0 THEN concat(h, ':30h')
    WHEN 1 THEN concat(h, '.15 h')
    WHEN 2 THEN concat(h, ' h')
    WHEN 3 THEN concat('Obertura a les ', h, 'h')
    WHEN 4 THEN concat('d''', h, ':00h a ', h, ':45')
    WHEN 5 THEN '25:00h'
    WHEN 6 THEN concat('12 h i ', h, ':30 h')
    WHEN 7 THEN concat(h, ':45 ', h, ':50')
    ELSE 'consultar web' END AS raw
FROM (SELECT event_id, CAST(hour(ts) AS @str@) AS h FROM events) AS a"""

VIEWS["f_month"] = """
SELECT CAST(month AS INT) AS month, ca, es, en
FROM (VALUES (1, 'gener', 'enero', 'january'), (2, 'febrer', 'febrero', 'february'), (3, 'març', 'marzo', 'march'),
             (4, 'abril', 'abril', 'april'), (5, 'maig', 'mayo', 'may'), (6, 'juny', 'junio', 'june'),
             (7, 'juliol', 'julio', 'july'), (8, 'agost', 'agosto', 'august'), (9, 'setembre', 'septiembre', 'september'),
             (10, 'octubre', 'octubre', 'october'), (11, 'novembre', 'noviembre', 'november'),
             (12, 'desembre', 'diciembre', 'december')) AS m(month, ca, es, en)"""

# Fifteen ways to print a date or a run of dates, in three languages; some name impossible days or run backwards.
VIEWS["f_date_text"] = """
SELECT event_id, shape, d, d2, mo, y,
  CASE shape
    WHEN 0 THEN concat(d, ' de ', ca)
    WHEN 1 THEN concat('Del ', d, ' al ', d2, ' de ', ca)
    WHEN 2 THEN concat(d, ' i ', d2, ' de ', ca)
    WHEN 3 THEN concat('Del ', d, ' al ', d2, ' i 29 i 30 de ', ca)
    WHEN 4 THEN concat('Del ', d, ' al ', d2, ' de ', es, ' de ', y)
    WHEN 5 THEN concat(d, ' y ', d2, ' de ', es, ' de ', y)
    WHEN 6 THEN concat(d, ', ', d2, ' ', en, ' and 30 december')
    WHEN 7 THEN concat(en, ' ', d)
    WHEN 8 THEN concat('30 de ', ca, ' i 1 de desembre')
    WHEN 9 THEN concat(d, ' de foo')
    WHEN 10 THEN concat(lpad(d, 2, '0'), '/', CAST(m AS @str@), ' — ', d2, '/12/', substr(y, 3, 2))
    WHEN 11 THEN concat('del 30 de ', ca, ' al 2 de desembre')
    WHEN 12 THEN concat('Del ', d2, ' al ', d, ' de ', ca)
    WHEN 13 THEN concat('From ', d, ' ', en, ' to ', d2, ' December ', y)
    ELSE concat('de 11h a 13h, ', d, ' de ', es, ' a les 20:30') END AS raw
FROM (
  SELECT event_id, event_id % 15 AS shape, m.month AS m, CAST(1 + event_id % 20 AS @str@) AS d, CAST(3 + event_id % 20 AS @str@) AS d2,
         m.month AS mo, CAST(2024 + event_id % 2 AS @str@) AS y, ca, es, en
  FROM events JOIN f_month m ON m.month = 1 + event_id % 11
) AS a"""

VIEWS["f_words"] = """
SELECT doc_id, CAST(i % 10 * 80 AS BIGINT) AS left_px, CAST(floor(i / 10) * 20 AS BIGINT) AS top_px, word
FROM (@words@) AS w WHERE word <> ''"""

_SPARK["words"] = (
    "SELECT doc_id, CAST(i AS BIGINT) AS i, word FROM documents LATERAL VIEW posexplode(split(text, '[ \\n]')) t AS i, word"
)
_DUCK["words"] = (
    "SELECT doc_id, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) - 1 AS i, "
    "unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents"
)

# Links in every form a page writes them: absolute, protocol-relative, rooted, bare.
VIEWS["f_url"] = """
SELECT page_id, url,
  CASE page_id % 5
    WHEN 0 THEN url
    WHEN 1 THEN replace(replace(url, 'https:', ''), 'http:', '')
    WHEN 2 THEN concat('/ca/agenda/', CAST(page_id AS @str@), '/?id=', CAST(page_id AS @str@), '#info')
    WHEN 3 THEN concat('sessio/', CAST(page_id AS @str@), '//')
    ELSE concat('http://www.example.org/film/', CAST(page_id AS @str@)) END AS href
FROM pages"""

# Titles that carry time, genres and price, a series, or a version tag.
VIEWS["f_packed"] = """
SELECT event_id,
  concat(CASE WHEN start_time IS NULL THEN '' ELSE concat(start_time, 'h | ') END, title, ' (',
         coalesce(recurrence_hint, 'Jazz'), ', Soul) ',
         CASE WHEN price IS NULL THEN '' WHEN price = 'free' THEN 'Entrada libre' WHEN price = 'sold-out' THEN '-'
              ELSE replace(price, '€', ' €') END) AS packed,
  concat(title, CASE WHEN event_id % 3 = 0 THEN ' | Friday | Blues' WHEN event_id % 3 = 1 THEN ' |' ELSE '' END) AS with_series,
  concat(title, CASE WHEN event_id % 2 = 0 THEN ' – (VOSE) (estreno)' ELSE '' END) AS with_tag,
  CASE WHEN image_url IS NULL THEN 'data:image/gif;base64,R0 1w, https://img.example.org/b.jpg 2w'
       ELSE concat(image_url, ' 300w, https://img.example.org/large.jpg 600w') END AS srcset,
  image_url
FROM f_event"""

# JSON-LD of each event, one document per event; every document of one venue is cut short.
VIEWS["f_jsonld"] = """
SELECT event_id, venue_id,
  concat('[{"@type":"', CASE WHEN event_id % 13 = 0 THEN 'Place' ELSE 'Event' END, '","name":"', title,
         '","url":"', source_url, '","startDate":"', CAST(start_date AS @str@),
         CASE WHEN start_time IS NULL THEN '' ELSE concat('T', start_time, ':00+01:00') END,
         '","endDate":"', CAST(start_date AS @str@),
         CASE WHEN event_id % 4 = 0 THEN 'T23:59:59+01:00' WHEN start_time IS NULL THEN '' ELSE concat('T', start_time, ':00+01:00') END,
         '","image":"', coalesce(image_url, ''), '","description":"', coalesce(description, ''),
         '","offers":{"price":"', CAST(event_id % 30 AS @str@),
         CASE WHEN event_id % 2 = 0 THEN '.50' ELSE '' END, '","priceCurrency":"EUR","availability":"https://schema.org/',
         CASE WHEN event_id % 6 = 2 THEN 'SoldOut' ELSE 'InStock' END, '"}}',
         CASE WHEN venue_id = 4 THEN '' ELSE ']' END) AS doc
FROM f_event"""

# One page per event: structured data, a card whose class list carries data, a second card, a label list.
VIEWS["f_event_page"] = """
SELECT e.event_id, concat('<html lang="ca"><head><title>', title, '</title><script type="application/ld+json">', j.doc, '</script>',
    CASE WHEN e.event_id % 3 = 0 THEN '<script type="application/ld+json">{not json</script>' ELSE '' END, '</head><body>',
    '<article class="card ', CAST(start_date AS @str@), ' ', coalesce(start_time, 'x'), ':00 id_', CAST(e.event_id AS @str@), ' dis_', CAST(e.event_id % 20 AS @str@),
    CASE WHEN e.event_id % 2 = 0 THEN ' funcio-9' ELSE '' END, '"><h3>', title, '</h3><a href="', source_url, '">', coalesce(price, '-'), '</a></article>',
    '<article class="plain"><h3>', category, '</h3></article></body></html>') AS html
FROM f_event e JOIN f_jsonld j ON j.event_id = e.event_id"""

# A film's card with a card per session in it, both plain elements of one kind; comments, scripts and unclosed tags between.
VIEWS["f_nested_page"] = """
SELECT event_id, concat('<html><body><!-- <div class="card old"> --><div id="main"><script>var s = "<div class=\\"card \\">";</script><div class="card film"><div><b>', title,
    '</div><br><div class="list">', @sessions@, '</div></div><div class="card plain"/></div></div></body></html>') AS html
FROM f_event"""

_SPARK["sessions"] = (
    "array_join(transform(start_times, (t, i) -> concat('<div class=\"card session\" id-ses=\"', event_id, '-', i + 1, '\"><div>', t, '</div></div>')), '')"
)
_DUCK["sessions"] = (
    "array_to_string([concat('<div class=\"card session\" id-ses=\"', event_id, '-', i, '\"><div>', t, '</div></div>') for t, i in start_times], '')"
)

# A feed whose documents change their shape: titles plain or by language, flags in any form, sessions as a list or by id.
VIEWS["f_feed"] = """
SELECT event_id,
  CASE WHEN event_id % 11 = 4 THEN '{"title":"cut short' WHEN event_id % 11 = 5 THEN CAST(NULL AS @str@) ELSE
    concat('{"title":', CASE event_id % 4 WHEN 0 THEN concat('{"ca":"', title, '","es":"ES"}') WHEN 1 THEN concat('{"ca":" ","es":"', title, '"}')
        WHEN 2 THEN concat('"', title, '"') ELSE concat('{"es":"', title, '"}') END,
      CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ',"free":true' WHEN 2 THEN ',"free":"1"' WHEN 3 THEN ',"free":0' WHEN 4 THEN ',"free":"False"' WHEN 5 THEN ',"free":null' ELSE ',"free":"yes"' END,
      ',"offer":{"amount":', CASE WHEN event_id % 3 = 0 THEN concat('"', CAST(event_id % 30 AS @str@), '.5"') ELSE CAST(event_id % 30 AS @str@) END, '}',
      CASE WHEN event_id % 5 = 0 THEN concat(',"sessions":[', @listed@, ']') WHEN event_id % 5 = 1 THEN ',"sessions":"soon"' WHEN event_id % 5 = 2 THEN ''
        ELSE concat(',"sessions":{', @keyed@, '}') END, '}') END AS doc
FROM f_event"""

_SPARK["listed"] = "array_join(transform(start_times, t -> concat('{\"at\":\"', t, '\",\"hidden\":false}')), ',')"
_DUCK["listed"] = "array_to_string([concat('{\"at\":\"', t, '\",\"hidden\":false}') for t in start_times], ',')"
_SPARK["keyed"] = "array_join(transform(start_times, (t, i) -> concat('\"s', i + 1, '\":{\"at\":\"', t, '\",\"hidden\":', IF(i = 1, 'true', 'null'), '}')), ',')"
_DUCK["keyed"] = "array_to_string([concat('\"s', i, '\":{\"at\":\"', t, '\",\"hidden\":', CASE WHEN i = 2 THEN 'true' ELSE 'null' END, '}') for t, i in start_times], ',')"

_NAME = re.compile(r"\b(f_[a-z_]+)\b")


def _fill(text: str, tokens: dict[str, str]) -> str:
    return re.sub(r"@(\w+)@", lambda m: tokens[m.group(1)], text)


def needed_views(sql: str) -> list[str]:
    """Views a statement refers to, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def check_sql(body: str) -> str:
    """The SQL check for a query: its body with the views it uses put in front."""
    names = needed_views(body)
    body = body.strip()
    ctes = [f"{n} AS ({_fill(VIEWS[n], _DUCK).strip()})" for n in names]
    if not ctes:
        return body
    opening = "WITH "
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            opening, body = start, ", " + body[len(start):]
            break
    return opening + ",\n".join(ctes) + "\n" + body


class Tables:
    """The given tables of one folder and the entities projected from them, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if f"f_{name}" in VIEWS:
            return self.view(f"f_{name}")
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            text = _fill(VIEWS[name], _SPARK)
            frames = {}
            for word in set(re.findall(r"\b[a-z_]+\b", text)):
                if word in BASE_TABLES and re.search(rf"(FROM|JOIN)\s+{word}\b", text):
                    frames[word] = self.base(word)
                elif word in VIEWS:
                    frames[word] = self.view(word)
            text = text.replace("{", "{{").replace("}", "}}")
            text = re.sub(
                r"(FROM|JOIN)(\s+)([a-z_]+)\b",
                lambda m: f"{m[1]}{m[2]}{{{m[3]}}}" if m[3] in frames else m[0],
                text,
            )
            self._made[name] = self.spark.sql(text, **frames)
        return self._made[name]
