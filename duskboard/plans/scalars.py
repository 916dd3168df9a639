"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.functions import categories as C
from duskboard.functions import dates as D
from duskboard.functions import price as P
from duskboard.functions import text as X
from duskboard.plans.registry import TODAY, query
from duskboard.sources.feeds import Field, localized, parse_documents, read_fields
from duskboard.sources.views import Tables


def sq(col: str) -> str:
    """SQL twin of ``squeeze``."""
    return f"trim(regexp_replace({col}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def ents(col: str) -> str:
    """SQL twin of ``decode_entities`` for the entities the given pages use."""
    out = col
    for k, v in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&eacute;": "é",
                 "&egrave;": "è", "&ccedil;": "ç", "&hellip;": "…", "&euro;": "€", "&mdash;": "—", "&ndash;": "–", "&middot;": "·", "&copy;": "©",
                 "&amp;": "&"}.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


def visible(col: str) -> str:
    """SQL twin of ``strip_html``."""
    out = f"regexp_replace({col}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<script[^>]*>.*?</script>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g')"
    return sq(ents(out))


def slug(col: str) -> str:
    """SQL twin of ``slugify``."""
    out = rf"lower(strip_accents(regexp_replace({col}, '\([^)]*\)', '', 'g')))"
    out = f"regexp_replace({out}, '[^\\x00-\\x7F]', '', 'g')"
    return f"regexp_replace(regexp_replace({out}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


H1 = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query("clean_text", rf"""
SELECT doc_id AS id, 'doc' AS kind, md5({sq(ents('text'))}) AS cleaned, length({sq(ents('text'))}) AS n FROM documents
UNION ALL
SELECT page_id, 'page', md5({sq(ents('html'))}), length({sq(ents('html'))}) FROM pages""")
def clean_text(t: Tables) -> DataFrame:
    def shape(df, key, kind, c):
        df = df.select(F.col(key).alias("id"), F.lit(kind).alias("kind"), X.clean_text(c).alias("text"))
        return df.select("id", "kind", F.md5(F.col("text").cast("binary")).alias("cleaned"), F.length("text").cast("bigint").alias("n"))

    return shape(t.documents, "doc_id", "doc", "text").unionByName(shape(t.pages, "page_id", "page", "html"))


@query("strip_html", f"SELECT page_id, md5({visible('html')}) AS text_md5, length({visible('html')}) AS n FROM pages")
def strip_html(t: Tables) -> DataFrame:
    df = t.pages.select("page_id", X.strip_html("html").alias("text"))
    return df.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query("slugify", f"""
SELECT page_id AS id, {slug(H1)} AS slug FROM pages
UNION ALL SELECT event_id, {slug('title')} FROM f_event""")
def slugify(t: Tables) -> DataFrame:
    pages = t.pages.select(F.col("page_id").alias("id"), X.slugify(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("slug"))
    return pages.unionByName(t.event.select(F.col("event_id").alias("id"), X.slugify("title").alias("slug")))


@query("absolutize_url", """
SELECT page_id, CASE WHEN starts_with(u, 'http://www.example.org') THEN 'https' || substr(u, 5) ELSE u END AS url
FROM (SELECT page_id, CASE WHEN starts_with(href, '//') THEN 'https:' || href
  WHEN starts_with(href, '/') THEN 'https://www.example.org' || href
  WHEN starts_with(href, 'http') THEN href ELSE 'https://www.example.org/' || href END AS u FROM f_url)""")
def absolutize_url(t: Tables) -> DataFrame:
    return t.url.select("page_id", X.absolutize_url("href", "https://www.example.org").alias("url"))


@query("normalize_url", """
SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') AS url,
  regexp_replace(split_part(split_part(href, '?', 1), '#', 1), '/+$', '') AS href FROM f_url""")
def normalize_url(t: Tables) -> DataFrame:
    return t.url.select("page_id", X.normalize_url("url").alias("url"), X.normalize_url("href").alias("href"))


@query("url_slug", """
SELECT page_id, list_last(string_split(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', ''), '/')) AS slug,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_no,
  nullif(regexp_extract(href, '[?&]id=([^&#]*)', 1), '') AS link_id FROM f_url""")
def url_slug(t: Tables) -> DataFrame:
    return t.url.select("page_id", X.url_slug("url").alias("slug"), X.url_param("url", "page").alias("page_no"),
                        X.url_param("href", "id").alias("link_id"))


# Path prefix per language.
LANGUAGE_PATHS = {"ca": "esdeveniment", "es": "es/evento", "en": "en/event"}


@query("localized_urls", """
SELECT event_id, lang, 'https://venue-' || venue_id || '.example.org/' || prefix || '/' || CAST(event_id // 3 AS VARCHAR) AS url
FROM f_event, (VALUES ('ca', 'esdeveniment'), ('es', 'es/evento'), ('en', 'en/event')) AS p(lang, prefix)""")
def localized_urls(t: Tables) -> DataFrame:
    return t.event.select("event_id", F.explode(X.localized_urls("source_url", LANGUAGE_PATHS)).alias("u")).select(
        "event_id", "u.lang", "u.url")


@query("film_key", r"""
SELECT event_id, trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS bare,
  lower(trim(regexp_replace(title, '\s*[(\[][^()\[\]]*[)\]]\s*$', ''))) AS film_key FROM f_event""")
def film_key(t: Tables) -> DataFrame:
    return t.event.select("event_id", X.strip_bracket_suffix("title").alias("bare"), X.film_key("title").alias("film_key"))


@query("strip_bracket_suffix", r"""
SELECT event_id, trim(regexp_replace(packed, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS packed, trim(regexp_replace(with_tag, '\s*[(\[][^()\[\]]*[)\]]\s*$', '')) AS tagged FROM f_packed""")
def strip_bracket_suffix(t: Tables) -> DataFrame:
    return t.packed.select("event_id", X.strip_bracket_suffix("packed").alias("packed"), X.strip_bracket_suffix("with_tag").alias("tagged"))


@query("split_title", r"""
WITH a AS (
  SELECT event_id, with_series, with_tag, packed,
    regexp_extract(packed, '^\s*(\d{1,2}:\d{2})h', 1) AS t,
    regexp_replace(packed, '^\s*\d{1,2}:\d{2}h\s*\|\s*', '') AS rest FROM f_packed),
b AS (
  SELECT *, rest LIKE '%Entrada libre%' AS is_free, regexp_extract(rest, '(\d+\s*€)\s*$', 1) AS amount FROM a),
c AS (
  SELECT *, CASE WHEN is_free THEN replace(rest, 'Entrada libre', '') ELSE regexp_replace(rest, '\d+\s*€\s*$', '') END AS named FROM b),
d AS (SELECT *, regexp_extract(named, '^.*\(([^()]*)\)', 1) AS inside FROM c)
SELECT event_id,
  regexp_replace(trim(regexp_replace(replace(named, '(' || inside || ')', ''), '\s+', ' ', 'g')), '^[ \-|·–]+|[ \-|·–]+$', '', 'g') AS title,
  nullif(t, '') AS start_time,
  CASE WHEN is_free THEN 'free' WHEN amount <> '' THEN replace(amount, ' ', '') END AS price,
  array_to_string([trim(x) for x in string_split(inside, ',')], '|') AS genres,
  CASE WHEN with_series LIKE '% | Friday | Blues' THEN replace(with_series, ' | Blues', '') ELSE trim(with_series) END AS series_title,
  CASE WHEN with_series LIKE '% | Friday | Blues' THEN 'Blues' END AS series,
  regexp_replace(split_part(with_tag, '(', 1), '[ –-]+$', '') AS plain_title,
  nullif(upper(regexp_extract(with_tag, '\((VO[^)]*)\)', 1)), '') AS tag
FROM d""")
def split_title(t: Tables) -> DataFrame:
    parts = t.packed.select("event_id", X.split_packed_title("packed").alias("p"), X.split_series("with_series").alias("s"),
                            X.split_version_tag("with_tag").alias("v"))
    return parts.select(
        "event_id", "p.title", "p.start_time", "p.price", F.array_join("p.genres", "|").alias("genres"),
        F.col("s.title").alias("series_title"), "s.series", F.col("v.title").alias("plain_title"), "v.tag")


@query("truncate_description", """
SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN rtrim(left(text, 500)) || '…' ELSE text END) AS cut,
  length(CASE WHEN length(text) > 500 THEN rtrim(left(text, 500)) || '…' ELSE text END) AS n FROM documents""")
def truncate_description(t: Tables) -> DataFrame:
    cut = X.truncate_description("text")
    return t.documents.select("doc_id", F.md5(cut.cast("binary")).alias("cut"), F.length(cut).cast("bigint").alias("n"))


@query("srcset_first", """
SELECT event_id, CASE WHEN srcset LIKE 'http%' THEN split_part(trim(split_part(srcset, ',', 1)), ' ', 1) ELSE image_url END AS image
FROM f_packed""")
def srcset_first(t: Tables) -> DataFrame:
    return t.packed.select("event_id", X.srcset_first("srcset", "image_url").alias("image"))


@query("external_id", """
SELECT event_id, coalesce(external_id, venue_slug || '@' || strftime(start_date, '%Y-%m-%d') || 'T' || coalesce(replace(start_time, ':', ''), '0000')) AS made_id,
  strftime(start_date, '%Y-%m-%d') || 'T' || coalesce(replace(start_time, ':', ''), '0000') || '-' || left(md5(title), 8) AS hashed_id,
  venue_id || '_' || event_id AS composite_id FROM f_event""")
def external_id(t: Tables) -> DataFrame:
    return t.event.select(
        "event_id", X.external_id("external_id", "venue_slug", "start_date", "start_time").alias("made_id"),
        X.hashed_external_id("start_date", "start_time", "title").alias("hashed_id"),
        F.concat_ws("_", "venue_id", "event_id").alias("composite_id"))


RANGE = "CASE WHEN {hi} <= 0 OR {lo} = {hi} OR {hi} < 2 * {lo} THEN {hi} || '€' ELSE {lo} || '–' || {hi} || '€' END"


@query("format_eur_range", f"SELECT event_id, {RANGE.format(lo='lo', hi='hi')} AS price, {RANGE.format(lo='0', hi='(lo - 5)')} AS edge FROM f_price_text")
def format_eur_range(t: Tables) -> DataFrame:
    return t.price_text.select("event_id", P.format_eur_range("lo", "hi").alias("price"),
                               P.format_eur_range(F.lit(0), F.col("lo") - 5).alias("edge"))


def marked(words: dict[str, str], policy: str) -> str:
    return f"regexp_matches(r, '{words[policy]}')"


@query("normalize_price", f"""
WITH a AS (SELECT event_id, lower(trim(raw)) AS r FROM f_price_text),
b AS (SELECT event_id, r,
  [CAST(replace(x, ',', '.') AS DOUBLE) for x in list_concat(list_concat(
     regexp_extract_all(r, '([0-9]+(?:[.,][0-9]+)?)\\s*(?:€|euros?)', 1),
     regexp_extract_all(r, '€\\s*([0-9]+(?:[.,][0-9]+)?)', 1)),
     regexp_extract_all(r, '€\\s*[0-9]+-([0-9]+)', 1))] AS v FROM a),
c AS (SELECT event_id, r, len(v) AS n,
  CAST(floor(list_min(v)) AS INT) AS lo_f, CAST(floor(list_max(v)) AS INT) AS hi_f,
  CAST(round_even(list_min(v), 0) AS INT) AS lo_e, CAST(round_even(list_max(v), 0) AS INT) AS hi_e FROM b)
SELECT event_id,
  CASE WHEN r IS NULL THEN NULL WHEN {marked(P.SOLD_OUT, 'sold_free_amount')} THEN 'sold-out' WHEN {marked(P.FREE, 'sold_free_amount')} THEN 'free'
       WHEN n > 0 THEN {RANGE.format(lo='lo_f', hi='hi_f')} END AS sold_free_amount,
  CASE WHEN r IS NULL THEN NULL WHEN {marked(P.FREE, 'free_sold_amount')} THEN 'free' WHEN {marked(P.SOLD_OUT, 'free_sold_amount')} THEN 'sold-out'
       WHEN n > 0 THEN {RANGE.format(lo='lo_e', hi='hi_e')} END AS free_sold_amount,
  CASE WHEN r IS NULL OR regexp_matches(r, '(a|per)\\s+determinar|tbd') THEN NULL
       WHEN n > 0 AND regexp_matches(r, '\\bde\\b.*\\ba\\b') THEN {RANGE.format(lo='lo_f', hi='hi_f')}
       WHEN n > 0 THEN hi_f || '€' WHEN {marked(P.SOLD_OUT, 'amount_sold_free')} THEN 'sold-out' WHEN {marked(P.FREE, 'amount_sold_free')} THEN 'free' END AS amount_sold_free,
  CASE WHEN r IS NULL THEN NULL WHEN {marked(P.SOLD_OUT, 'sold_amount_free')} THEN 'sold-out' WHEN n > 0 THEN {RANGE.format(lo='lo_e', hi='hi_e')}
       WHEN {marked(P.FREE, 'sold_amount_free')} THEN 'free' END AS sold_amount_free,
  CASE WHEN r IS NULL THEN NULL WHEN regexp_matches(r, 'inclòs|preu de l''entrada') THEN 'free' WHEN n > 0 THEN hi_f || '€'
       WHEN {marked(P.FREE, 'bundled_amount_free')} THEN 'free' END AS bundled_amount_free
FROM c""")
def normalize_price(t: Tables) -> DataFrame:
    return t.price_text.select("event_id", *[P.normalize_price("raw", p).alias(p) for p in P.POLICIES])


@query("cut_price_tiers", r"""
WITH a AS (SELECT event_id, regexp_replace(lower(raw),
    '(?s)(\(|/|socis|abonats|palau jove|aula palau|especial|discapacitat|anticipada|general).*$', '') AS main FROM f_price_text),
b AS (SELECT event_id, [x for x in [CAST(m AS INT) for m in regexp_extract_all(main, '([0-9]+)(?:[.,][0-9]+)?', 1)] if x > 0 AND x <= 500] AS v FROM a)
SELECT event_id, list_min(v) AS lo, list_max(v) AS hi, CAST(coalesce(len(v), -1) AS BIGINT) AS n FROM b""")
def cut_price_tiers(t: Tables) -> DataFrame:
    return t.price_text.select("event_id", P.cut_price_tiers("raw").alias("v")).select(
        "event_id", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"),
        F.coalesce(F.size("v"), F.lit(-1)).cast("bigint").alias("n"))


@query("structured_price", f"""
WITH a AS (SELECT event_id, TRY_CAST(json_extract_string(d, '$[0].offers.price') AS DOUBLE) AS p,
    json_extract_string(d, '$[0].offers.availability') AS av
  FROM (SELECT event_id, TRY_CAST(doc AS JSON) AS d FROM f_jsonld)),
b AS (SELECT *, CAST(round_even(p, 0) AS INT) AS lo, CAST(round_even(p * 3, 0) AS INT) AS hi FROM a)
SELECT event_id, CASE WHEN av LIKE '%SoldOut' THEN 'sold-out' WHEN p IS NULL THEN NULL WHEN p = 0 THEN 'free' ELSE lo || '€' END AS flat,
  CASE WHEN av LIKE '%SoldOut' THEN 'sold-out' WHEN p IS NULL THEN NULL WHEN p = 0 THEN 'free' ELSE {RANGE.format(lo='lo', hi='hi')} END AS ranged,
  CASE WHEN av LIKE '%SoldOut' THEN 'sold-out' WHEN p IS NULL THEN NULL WHEN p = 0 THEN 'free' WHEN p = floor(p) THEN CAST(p AS BIGINT) || '€' ELSE CAST(p AS VARCHAR) || '€' END AS exact,
  CASE WHEN event_id % 100 = 0 THEN ((event_id % 4000) // 100) || '€' ELSE ((event_id % 4000) // 100) || ',' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') || '€' END AS from_cents
FROM b""")
def structured_price(t: Tables) -> DataFrame:
    doc = t.jsonld
    ok = F.from_json("doc", "array<struct<offers:struct<price:string,availability:string>>>")
    a = doc.select("event_id", ok[0]["offers"]["price"].alias("p"), ok[0]["offers"]["availability"].alias("av"))
    cents = F.array(F.lit("n/a"), F.lit("0"), (F.col("event_id") % 4000).cast("string"))
    top = F.col("p").try_cast("double") * 3
    return a.select(
        "event_id", P.structured_price("p", "av").alias("flat"),
        P.structured_price("p", "av", F.col("p"), top).alias("ranged"),
        P.structured_price("p", "av", cents=True).alias("exact"), P.cents_price(cents).alias("from_cents"))


@query("price_bounds", r"""
WITH a AS (SELECT event_id, [CAST(replace(x, ',', '.') AS DOUBLE) for x in list_concat(list_concat(
     regexp_extract_all(lower(raw), '([0-9]+(?:[.,][0-9]+)?)\s*(?:€|euros?)', 1),
     regexp_extract_all(lower(raw), '€\s*([0-9]+(?:[.,][0-9]+)?)', 1)),
     regexp_extract_all(lower(raw), '€\s*[0-9]+-([0-9]+)', 1))] AS v FROM f_price_text)
SELECT event_id, CAST(round_even(list_min(v), 0) AS INT) AS lo, CAST(round_even(list_max(v), 0) AS INT) AS hi FROM a""")
def price_bounds(t: Tables) -> DataFrame:
    b = P.price_bounds(P.euro_amounts(F.lower("raw")))
    return t.price_text.select("event_id", b["lo"].alias("lo"), b["hi"].alias("hi"))


@query("parse_date_any", """
SELECT event_id, form, CASE WHEN form = 5 THEN NULL ELSE d END AS parsed FROM (
  SELECT event_id, event_id % 7 AS form, start_date AS d FROM f_event)""")
def parse_date_any(t: Tables) -> DataFrame:
    d = F.col("start_date")
    en = F.element_at(F.array(*[F.lit(m) for m in D.MONTH_NAMES["en"]]), F.month(d))
    es = F.element_at(F.array(*[F.lit(m) for m in D.MONTH_NAMES["es"]]), F.month(d))
    form = F.col("event_id") % 7
    raw = (
        F.when(form == 0, F.date_format(d, "dd/MM/yyyy")).when(form == 1, F.concat(F.lit("Del "), F.date_format(d, "d/M/yy")))
        .when(form == 2, F.date_format(d, "dd.MM.yyyy")).when(form == 3, F.date_format(d, "yyyyMMdd"))
        .when(form == 4, F.concat(F.date_format(d, "d"), F.lit(" de "), es, F.lit(" de "), F.date_format(d, "yyyy")))
        .when(form == 5, F.lit("30/02/2024"))
        .otherwise(F.concat(F.lit("Fri,  "), F.date_format(d, "d"), F.lit(" "), F.initcap(F.substring(en, 1, 3)), F.lit(" "), F.date_format(d, "yyyy 18:00"))))
    return t.event.select("event_id", form.alias("form"), D.parse_date_any(raw).alias("parsed"))


@query("month_number", """
SELECT event_id, m.month AS from_ca, m.month AS from_es, m.month AS from_short, CAST(NULL AS INT) AS unknown
FROM f_event JOIN f_month m ON m.month = 1 + event_id % 12""")
def month_number(t: Tables) -> DataFrame:
    df = t.event.join(t.month, F.col("month") == 1 + F.col("event_id") % 12)
    return df.select(
        "event_id", D.month_number(F.upper("ca")).alias("from_ca"), D.month_number("es").alias("from_es"),
        D.month_number(F.substring("en", 1, 3)).alias("from_short"), D.month_number(F.concat(F.lit("x"), "en")).alias("unknown"))


@query("parse_date_phrase", """
WITH a AS (SELECT *, CAST(d AS INT) AS n, CAST(d2 AS INT) AS n2, CAST(CASE WHEN shape IN (4, 5, 10, 13) THEN CAST(y AS INT) ELSE 2024 END AS VARCHAR) AS yr FROM f_date_text),
parts AS (
  SELECT event_id, yr, CAST(mo AS VARCHAR) AS m, unnest(CASE
    WHEN shape IN (1, 4) THEN [{'a': n, 'ma': mo, 'z': n2, 'mz': mo}]
    WHEN shape IN (2, 5) THEN [{'a': n, 'ma': mo, 'z': n, 'mz': mo}, {'a': n2, 'ma': mo, 'z': n2, 'mz': mo}]
    WHEN shape = 3 THEN [{'a': n, 'ma': mo, 'z': n2, 'mz': mo}, {'a': 29, 'ma': mo, 'z': 29, 'mz': mo}, {'a': 30, 'ma': mo, 'z': 30, 'mz': mo}]
    WHEN shape = 6 THEN [{'a': n, 'ma': mo, 'z': n, 'mz': mo}, {'a': n2, 'ma': mo, 'z': n2, 'mz': mo}, {'a': 30, 'ma': 12, 'z': 30, 'mz': 12}]
    WHEN shape IN (0, 7, 14) THEN [{'a': n, 'ma': mo, 'z': n, 'mz': mo}]
    WHEN shape = 8 THEN [{'a': 30, 'ma': mo, 'z': 30, 'mz': mo}, {'a': 1, 'ma': 12, 'z': 1, 'mz': 12}]
    WHEN shape IN (10, 13) THEN [{'a': n, 'ma': mo, 'z': n2, 'mz': 12}]
    WHEN shape = 11 THEN [{'a': 30, 'ma': mo, 'z': 2, 'mz': 12}] ELSE [] END) AS p FROM a),
spans AS (
  SELECT event_id, TRY_CAST(yr || '-' || lpad(CAST(p.ma AS VARCHAR), 2, '0') || '-' || lpad(CAST(p.a AS VARCHAR), 2, '0') AS DATE) AS s,
    TRY_CAST(yr || '-' || lpad(CAST(p.mz AS VARCHAR), 2, '0') || '-' || lpad(CAST(p.z AS VARCHAR), 2, '0') AS DATE) AS e FROM parts),
days AS (SELECT DISTINCT event_id, CAST(unnest(generate_series(coalesce(s, e), e, INTERVAL 1 DAY)) AS DATE) AS day FROM spans WHERE e IS NOT NULL)
SELECT t.event_id, coalesce(string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day), '') AS days, min(day) AS start_date, nullif(max(day), min(day)) AS end_date,
  any_value(shape IN (4, 5, 10, 13)) AS dated
FROM f_date_text t LEFT JOIN days USING (event_id) GROUP BY t.event_id""")
def parse_date_phrase(t: Tables) -> DataFrame:
    read = t.date_text.select("event_id", D.date_phrase("raw", F.lit(TODAY)).alias("phrase"))
    days = F.transform(D.phrase_days(F.col("phrase")), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return read.select("event_id", F.array_join(days, ",").alias("days"), D.phrase_span(F.col("phrase")).alias("span"), "phrase.dated").select("event_id", "days", "span.*", "dated")


@query("infer_year", """
WITH a AS (SELECT event_id, CAST(d AS INT) AS d, mo AS m, event_id % 7 AS wd, DATE '2024-06-15' AS today FROM f_date_text),
b AS (SELECT *, [TRY_CAST(CAST(y AS VARCHAR) || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) for y in [2023, 2024, 2025, 2026]] AS c FROM a)
SELECT event_id, CASE WHEN m < 6 THEN 2025 ELSE 2024 END AS by_month,
  CASE WHEN today - c[2] > 90 THEN c[3] ELSE c[2] END AS recent,
  CASE WHEN c[2] >= DATE '2024-05-16' THEN c[2] WHEN c[3] IS NOT NULL THEN c[3] WHEN c[1] >= DATE '2024-05-16' THEN c[1] END AS published,
  CASE WHEN c[2] >= today AND isodow(c[2]) - 1 = wd THEN 2024 WHEN c[3] >= today AND isodow(c[3]) - 1 = wd THEN 2025
       WHEN c[4] >= today AND isodow(c[4]) - 1 = wd THEN 2026 WHEN c[2] >= today THEN 2024 ELSE 2025 END AS by_weekday,
  CASE WHEN c[2] > today THEN c[1] ELSE c[2] END AS before_end
FROM b""")
def infer_year(t: Tables) -> DataFrame:
    import datetime as dt

    today = F.lit(dt.date(2024, 6, 15))
    day, month = F.col("d").cast("int"), F.col("mo")
    return t.date_text.select(
        "event_id", D.next_month_year(month, today).alias("by_month"), D.recent_or_next(day, month, today).alias("recent"),
        D.near_publication(day, month, today).alias("published"),
        D.weekday_year(day, month, (F.col("event_id") % 7).cast("int"), today).alias("by_weekday"),
        D.year_before_end(day, month, today).alias("before_end"))


@query("parse_time_any", """
SELECT e.event_id, CASE e.event_id % 9
  WHEN 0 THEN h || ':30' WHEN 1 THEN h || ':15' WHEN 2 THEN h || ':00' WHEN 3 THEN h || ':00' WHEN 4 THEN h || ':00'
  WHEN 6 THEN h || ':30' WHEN 7 THEN h || ':45' END AS parsed
FROM (SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h FROM events) e""")
def parse_time_any(t: Tables) -> DataFrame:
    return t.time_text.select("event_id", D.parse_time_any("raw").alias("parsed"))


@query("all_times", """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN h || ':30' WHEN 4 THEN h || ':00,' || h || ':45' WHEN 6 THEN h || ':30'
  WHEN 7 THEN h || ':45,' || h || ':50' ELSE '' END AS times
FROM (SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h FROM events)""")
def all_times(t: Tables) -> DataFrame:
    return t.time_text.select("event_id", F.array_join(D.all_times("raw"), ",").alias("times"))


# Stamps are moved through the year by the event's number, so that both clock changes are met.
STAMP = "date_trunc('second', ts) + to_hours(CAST(event_id % 8760 AS INT))"


@query("epoch_to_local", f"""
SELECT event_id, CAST(l AS DATE) AS local_date, strftime(l, '%H:%M') AS local_time,
  CAST(l2 AS DATE) AS shifted_date, strftime(l2, '%H:%M') AS shifted_time
FROM (SELECT event_id, timezone('Europe/Madrid', s AT TIME ZONE 'UTC') AS l, timezone('Europe/Madrid', (s + INTERVAL 2 HOUR) AT TIME ZONE 'UTC') AS l2
  FROM (SELECT event_id, {STAMP} AS s FROM events))""")
def epoch_to_local(t: Tables) -> DataFrame:
    stamp = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 8760).cast("int"))
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), stamp)
    df = t.events.select("event_id", epoch.alias("epoch_s"))
    a, b = D.epoch_to_local("epoch_s"), D.epoch_to_local("epoch_s", offset_hours=2)
    return df.select("event_id", a["date"].alias("local_date"), a["time"].alias("local_time"),
                     b["date"].alias("shifted_date"), b["time"].alias("shifted_time"))


@query("iso_wall_clock", """
SELECT event_id, start_date AS wall_date, start_time AS wall_time FROM f_event""")
def iso_wall_clock(t: Tables) -> DataFrame:
    iso = F.concat(
        F.date_format("start_date", "yyyy-MM-dd"),
        F.when(F.col("start_time").isNull(), F.lit("")).otherwise(F.concat(F.lit("T"), F.col("start_time"), F.lit(":00+02:00"))))
    w = D.iso_wall_clock(iso)
    return t.event.select("event_id", w["date"].alias("wall_date"), w["time"].alias("wall_time"))


@query("utc_link_to_local", f"""
SELECT event_id, CAST(l AS DATE) AS local_date, strftime(l, '%H:%M') AS local_time
FROM (SELECT event_id, timezone('Europe/Madrid', ({STAMP}) AT TIME ZONE 'UTC') AS l FROM events)""")
def utc_link_to_local(t: Tables) -> DataFrame:
    stamp = F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 8760).cast("int"))
    link = F.concat(F.lit("https://calendar.example.org/render?dates="), F.date_format(stamp, "yyyyMMdd'T'HHmmss"), F.lit("Z/x"))
    w = D.utc_link_to_local(link)
    return t.events.select("event_id", w["date"].alias("local_date"), w["time"].alias("local_time"))


@query("all_day_sentinels", """
SELECT event_id, CASE WHEN start_time = '00:00' OR p IN (1, 2) THEN NULL ELSE start_time END AS start_time,
  CASE WHEN p = 2 OR (start_time = '00:00' AND e = '23:59') OR e = start_time THEN NULL ELSE e END AS end_time
FROM (SELECT event_id, start_time, event_id % 5 AS p, CASE WHEN event_id % 2 = 0 THEN start_time ELSE '23:59' END AS e FROM f_event)""")
def all_day_sentinels(t: Tables) -> DataFrame:
    p = F.col("event_id") % 5
    end = F.when(F.col("event_id") % 2 == 0, F.col("start_time")).otherwise(F.lit("23:59"))
    s = D.all_day_sentinels("start_time", end, p == 1, p == 2)
    return t.event.select("event_id", s["start_time"].alias("start_time"), s["end_time"].alias("end_time"))


@query("logical_date", """
SELECT event_id, CASE WHEN start_time < '05:00' THEN CAST(start_date - INTERVAL 1 DAY AS DATE) ELSE start_date END AS logical_date FROM f_event""")
def logical_date(t: Tables) -> DataFrame:
    return t.event.select("event_id", D.logical_date("start_date", "start_time").alias("logical_date"))


@query("time_sort_key", """
SELECT event_id, CASE WHEN start_time IS NULL THEN '0' WHEN start_time >= '05:00' THEN '1' || start_time ELSE '2' || start_time END AS k FROM f_event""")
def time_sort_key(t: Tables) -> DataFrame:
    return t.event.select("event_id", D.time_sort_key("start_time").alias("k"))


@query("earliest_session", """
SELECT event_id, coalesce(list_min(start_times), start_time) AS earliest FROM f_event""")
def earliest_session(t: Tables) -> DataFrame:
    return t.event.select("event_id", D.earliest_session("start_times", "start_time").alias("earliest"))


@query("date_span", """
SELECT event_id, start_date AS lo, end_date AS hi,
  coalesce(end_date, start_date) AS printed_first, CASE WHEN end_date IS NOT NULL THEN start_date END AS printed_last FROM f_event""")
def date_span(t: Tables) -> DataFrame:
    text = F.concat_ws(" al ", F.date_format("end_date", "dd/MM/yyyy"), F.lit("30/02/2024"), F.date_format("start_date", "dd/MM/yy"))
    dates = D.numeric_dates(text)
    a, b = D.date_span(dates), D.date_span(dates, ordered=True)
    return t.event.select("event_id", a["start_date"].alias("lo"), a["end_date"].alias("hi"),
                          b["start_date"].alias("printed_first"), b["end_date"].alias("printed_last"))


@query("annotations", """
SELECT event_id, array_to_string([x for x in list_distinct_ordered if lower(x) <> category], '|') AS labels FROM (
  SELECT event_id, category, [x for x, i in u if list_position(u, x) = i] AS list_distinct_ordered FROM (
    SELECT event_id, category, list_concat(coalesce(start_labels, []), [initcap]) AS u FROM (
      SELECT event_id, category, upper(left(category, 1)) || substr(category, 2) AS initcap, annotations AS start_labels FROM f_event)))""")
def annotations(t: Tables) -> DataFrame:
    compound = F.array_join("annotations", " / ")
    got = C.labels(compound, F.lit(""), F.initcap("category"), F.lit(None).cast("string"), without=F.col("category"))
    return t.event.select("event_id", F.array_join(got, "|").alias("labels"))


# A source's labels and the categories they stand for.
LABEL_MAP = {"ECONOMY": "theater", "PROMO": "theater", "LARGE": "dance", "SMALL": "kids", "STANDARD": "classical"}


@query("map_categories", """
WITH m AS (SELECT * FROM (VALUES ('ECONOMY', 'theater'), ('PROMO', 'theater'), ('LARGE', 'dance'), ('SMALL', 'kids'), ('STANDARD', 'classical')) AS v(label, slug))
SELECT event_id, coalesce(m.slug, 'theater') AS slugs,
  array_to_string([x for x in annotations if x NOT IN ('ECONOMY', 'PROMO', 'LARGE', 'SMALL', 'STANDARD')], '|') AS rest
FROM f_event LEFT JOIN m ON m.label = annotations[1]""")
def map_categories(t: Tables) -> DataFrame:
    c = C.map_categories("annotations", LABEL_MAP)
    return t.event.select("event_id", F.array_join(c["category_slugs"], "|").alias("slugs"), F.array_join(c["annotations"], "|").alias("rest"))


KEYWORD_RULES = [("ring|bolt", "dance"), ("widget.*\\(vose\\)|gear", "kids"), ("^hot ", "flamenco")]


@query("keyword_categories", r"""
SELECT event_id, CASE WHEN regexp_matches(lower(title), 'ring|bolt') THEN 'dance' WHEN regexp_matches(lower(title), 'widget.*\(vose\)|gear') THEN 'kids'
  WHEN regexp_matches(lower(title), '^hot ') THEN 'flamenco' ELSE category END AS category,
  concat_ws(',', category, CASE WHEN regexp_matches(lower(title), 'ring|bolt') THEN 'dance' END, CASE WHEN regexp_matches(lower(title), 'widget.*\(vose\)|gear') THEN 'kids' END,
    CASE WHEN regexp_matches(lower(title), '^hot ') THEN 'flamenco' END) AS with_added FROM f_event""")
def keyword_categories(t: Tables) -> DataFrame:
    base = F.col("category")
    return t.event.select("event_id", C.keyword_categories("title", KEYWORD_RULES, base).alias("category"),
                          F.array_join(C.added_categories("title", KEYWORD_RULES, base), ",").alias("with_added"))


#: Where the feed's fields stand.
FEED_FIELDS = {"title": localized("$.title"), "amount": Field("number", ("$.offer.amount",)), "free": Field("flag", ("$.free",))}


@query("json_event_fields", """
SELECT event_id, title, CAST(event_id % 30 + CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS amount, event_id % 7 IN (1, 2, 6) AS free
FROM f_event WHERE event_id % 11 NOT IN (4, 5)""")
def json_event_fields(t: Tables) -> DataFrame:
    return read_fields(parse_documents(t.feed, "doc")[0], "document", FEED_FIELDS)


@query("translations_array", """
SELECT event_id, lang, title, nullif(description, '') AS description FROM (
  SELECT event_id, 'es' AS lang, 'ES ' || title AS title, description FROM f_event WHERE description IS NOT NULL
  UNION ALL SELECT event_id, 'en', 'EN ' || title, NULL FROM f_event)""")
def translations_array(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    arr = C.translations_array({
        "es": (F.when(F.col("description").isNotNull(), F.concat(F.lit("ES "), "title")).otherwise(F.lit(" ")), F.col("description"), none),
        "en": (F.concat(F.lit("EN "), "title"), none, F.col("source_url"))})
    return t.event.select("event_id", F.explode(arr).alias("t")).select("event_id", "t.lang", "t.title", "t.description")


@query("recurrence_hint", """
SELECT event_id, CASE WHEN (lower(title) LIKE 'red%' AND lower(title) = 'red ring' AND isodow(start_date) = 1) OR recurrence_hint IS NOT NULL THEN 'every Monday'
  WHEN lower(title) LIKE '%jam%' THEN 'weekly' END AS hint FROM f_event""")
def recurrence_hint(t: Tables) -> DataFrame:
    said = F.concat(F.lit("Cada "), F.when(F.col("recurrence_hint").isNotNull(), F.lit("dilluns")).otherwise(F.lit("mes")))
    return t.event.select("event_id", C.recurrence_hint("title", "start_date", said, "Red Ring").alias("hint"))


@query("join_parts", """
SELECT event_id, CASE WHEN parts = [] THEN NULL ELSE array_to_string(parts, ' — ') END AS joined FROM (
  SELECT event_id, [x for x, i in u if x IS NOT NULL AND trim(x) <> '' AND list_position(u, x) = i] AS parts
  FROM (SELECT event_id, [description, recurrence_hint, '', price, recurrence_hint] AS u FROM f_event))""")
def join_parts(t: Tables) -> DataFrame:
    return t.event.select("event_id", X.join_parts("description", "recurrence_hint", F.lit(""), "price", "recurrence_hint").alias("joined"))


@query("status_override", """
SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'sold-out' ELSE price END AS price, event_id % 5 = 2 AS cancelled FROM f_event""")
def status_override(t: Tables) -> DataFrame:
    n = F.col("event_id") % 5
    badge = F.when(n == 1, F.lit("Sold Out!")).when(n == 2, F.lit("CANCEL·LAT")).when(n == 3, F.lit("Nou"))
    s = C.status_override(badge, "price")
    return t.event.select("event_id", s["price"].alias("price"), s["cancelled"].alias("cancelled"))
