"""Joins of listings with what belongs to them.

A side is broadcast by hand only behind a count of its bytes (:func:`broadcast_if_small`). Otherwise sizes are left
to Spark's threshold and to adaptive execution, which also splits skewed partitions. Literal lookup
tables (at most a few dozen rows) travel as map expressions instead of joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskboard.session import stored

#: Bytes up to which a side is sent to every task.
BROADCAST_BYTES = 32 << 20
#: Ids a row may hold to be resolved one position after the other.
CHAINED = 8


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: eight a number, a text's own length, what nested columns take as text."""
    widths = []
    for field in df.schema.fields:
        text = isinstance(field.dataType, (T.StringType, T.BinaryType))
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        c = F.to_json(F.struct(F.col(f"`{field.name}`"))) if nested else F.col(f"`{field.name}`")
        widths.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8 if text or nested else F.lit(8))
    return sum(widths[1:], widths[0]).cast("bigint")


def broadcast_if_small(df: DataFrame, bounded_by: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint, given only after adding up the bytes of the rows; a larger side is left to a shuffled join.

    ``bounded_by`` may name a table of at least as many bytes that is cheaper to read, such as the stored one ``df`` is
    made from. Every task adds up its share, so nothing but sums is sent.
    """
    counted = df if bounded_by is None else bounded_by
    size = counted.agg(F.sum(row_bytes(counted)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on ``key`` that no heavy key of ``left`` can hold up.

    A key is heavy if its rows would fill a quarter of a partition or more. There are at most four a partition, so their
    rows of ``right`` (few a key) go to all tasks, and only the other rows are shuffled.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("n")).scalar()
    heavy = counts.filter(F.col("_n") * (4 * parts) > total).select(key)
    light = left.join(F.broadcast(heavy), key, "left_anti").join(right, key)
    return light.unionByName(left.join(F.broadcast(right.join(F.broadcast(heavy), key)), key))


def whitelist(
    df: DataFrame, memberships: DataFrame, event_categories: DataFrame, bounded_by: DataFrame | None = None
) -> DataFrame:
    """Events of each list membership that pass its whitelist; a null whitelist passes all.

    ``memberships`` holds ``list_id, venue_id, whitelist_category_id`` and any columns that belong to
    the list or the venue. An event that a list reaches through several memberships comes back once.
    ``bounded_by`` is the table whose size decides on broadcasting, the memberships by default.
    """
    keys = [c for c in memberships.columns if c != "whitelist_category_id"]
    # One row per (list, venue): either the whole venue or the set of admitted categories.
    rules = memberships.groupBy(*keys).agg(
        F.bool_or(F.col("whitelist_category_id").isNull()).alias("_whole"),
        F.collect_set("whitelist_category_id").alias("_allowed"),
    )
    owned = event_categories.groupBy("event_id").agg(F.collect_set("category_id").alias("_has"))
    # The events are shuffled by event_id once, here; later joins on it reuse that.
    reached = df.join(broadcast_if_small(rules, memberships if bounded_by is None else bounded_by), "venue_id").join(owned, "event_id", "left")
    passes = F.col("_whole") | F.coalesce(F.arrays_overlap("_has", "_allowed"), F.lit(False))
    return reached.filter(passes).drop("_whole", "_allowed", "_has")


def list_events(
    lists: DataFrame,
    list_venues: DataFrame,
    venues: DataFrame,
    events: DataFrame,
    event_categories: DataFrame,
    slug: str | None = None,
) -> DataFrame:
    """Distinct events of one list, or of every list, with ``list_slug`` and ``venue_name``.

    Lists, memberships and venues meet first, so that the events are joined with one small table.
    """
    chosen = lists if slug is None else lists.filter(F.col("slug") == slug)
    members = (
        list_venues.select("list_id", "venue_id", "whitelist_category_id")
        .join(chosen.select("list_id", F.col("slug").alias("list_slug")), "list_id")
        .join(venues.select("venue_id", F.col("name").alias("venue_name")), "venue_id")
    )
    return whitelist(events, members, event_categories, bounded_by=list_venues).drop("list_id")


def localize(events: DataFrame, translations: DataFrame, locale: str) -> DataFrame:
    """Title and URL in one language; each falls back to the canonical one on its own."""
    t = translations.filter(F.col("lang") == locale).select(
        "event_id", F.col("title").alias("_title"), F.col("source_url").alias("_url")
    )
    out = events.join(t, "event_id", "left")
    return (
        out.withColumn("title", F.coalesce("_title", "title"))
        .withColumn("source_url", F.coalesce("_url", "source_url"))
        .drop("_title", "_url")
    )


def localize_all(events: DataFrame, translations: DataFrame, locales: Sequence[str]) -> DataFrame:
    """Every event once per locale.

    An event's translations become one row with a column per language, joined by event_id alone, so
    events already partitioned by it are not shuffled again; the locales fan out afterwards.
    """
    entry = F.struct(F.col("title").alias("t"), F.col("source_url").alias("u"))
    per_event = translations.filter(F.col("lang").isin(*locales)).groupBy("event_id").agg(
        *[F.max(F.when(F.col("lang") == x, entry)).alias(f"_tr_{x}") for x in locales]
    )
    versions = F.array(
        *[
            F.struct(
                F.lit(x).alias("locale"),
                F.coalesce(F.col(f"_tr_{x}.t"), F.col("title")).alias("title"),
                F.coalesce(F.col(f"_tr_{x}.u"), F.col("source_url")).alias("source_url"),
            )
            for x in locales
        ]
    )
    rest = [c for c in events.columns if c not in ("title", "source_url")]
    return (
        events.join(per_event, "event_id", "left")
        .select(*rest, F.explode(versions).alias("_v"))
        .select(*rest, "_v.*")
    )


def enrich(
    listing: DataFrame,
    detail: DataFrame,
    on: str,
    prefer: Mapping[str, str],
    how: str = "left",
) -> DataFrame:
    """Listing rows completed from their detail page; ``prefer`` says per column who wins.

    ``{"price": "detail", "title": "listing"}``; with ``how="inner"`` a row without its detail is
    dropped. Of several details with one key the row with the fewest gaps is taken, of
    equal ones the smallest; columns of different rows are never mixed.
    """
    cols = list(prefer)
    gaps = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)).alias("_gaps")
    one = detail.groupBy(on).agg(F.min(F.struct(gaps, *cols)).alias("_d")).select(on, *[F.col(f"_d.{c}").alias(f"_d_{c}") for c in cols])
    out = listing.join(one, on, how)
    for c in cols:
        mine = F.col(c) if c in listing.columns else F.lit(None)
        theirs = F.col(f"_d_{c}")
        out = out.withColumn(
            c, F.coalesce(theirs, mine) if prefer[c] == "detail" else F.coalesce(mine, theirs)
        ).drop(f"_d_{c}")
    return out


def resolve_ids(
    df: DataFrame, key: str, ids: str, dim: DataFrame, dim_id: str, dim_title: str, out: str, max_bytes: int = BROADCAST_BYTES,
    longest: int | None = None,
) -> DataFrame:
    """Array of ids to the array of their titles, in order; unknown and null ids are left out, a row without any gets an
    empty array.

    ``longest`` is the most ids of a row, counted if not given. Up to ``CHAINED`` they are looked up one position after the
    other and rows stay whole. Titles go to all tasks if they are few bytes, and no row is shuffled. Else those of the
    most frequent ids do (:func:`frequent_ids`), and the rows are shuffled once for each position that holds other ids.
    Longer arrays are exploded; their rows meet again by ``key``, which must be unique.
    """
    names = dim.select(F.col(dim_id).alias("_id"), F.col(dim_title).alias("_title")).filter(F.col("_id").isNotNull() & F.col("_title").isNotNull())
    if longest is None:
        longest = df.agg(F.max(F.size(ids)).alias("n")).first()["n"] or 0
    if longest > CHAINED:
        return _resolve_exploded(df, key, ids, names, out, max_bytes)
    rest = [c for c in df.columns if c != ids]
    none = F.array().cast(T.ArrayType(names.schema["_title"].dataType))
    titles = names.groupBy("_id").agg(F.array_sort(F.collect_list("_title")).alias("_titles"))
    sent, others = broadcast_if_small(titles, bounded_by=names, max_bytes=max_bytes), set()
    if sent is titles:
        often, others = frequent_ids(df, ids, names, max_bytes)
        sent = F.broadcast(often.join(titles, "_id", "left").withColumn("_titles", F.coalesce("_titles", none)))
    found = df
    for i in range(longest):
        at = f"_titles{i}"
        near = sent.select(F.col("_id").alias("_k"), F.col("_titles").alias(at))
        found = found.join(near, F.get(ids, F.lit(i)) == F.col("_k"), "left").drop("_k")
        if i in others:
            # A row without an id to look up here goes anywhere.
            wanted = F.when(F.col(at).isNull(), F.get(ids, F.lit(i)))
            anywhere = F.when(wanted.isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long"))
            far = titles.select(F.struct(F.col("_id").alias("id"), F.lit(0).cast("long").alias("at")).alias("_k"), F.col("_titles").alias("_far"))
            found = found.withColumn("_w", F.struct(wanted.alias("id"), anywhere.alias("at"))).join(far, F.col("_w") == F.col("_k"), "left")
            found = found.withColumn(at, F.coalesce(at, "_far")).drop("_w", "_k", "_far")
    joined = F.flatten(F.array(*[F.coalesce(f"_titles{i}", none) for i in range(longest)])) if longest > 0 else none
    checked = F.when(F.size(ids) > longest, F.raise_error(F.lit(f"more than {longest} ids in a row"))).otherwise(joined)
    return found.select(*rest, checked.alias(out))


def frequent_ids(df: DataFrame, ids: str, names: DataFrame, max_bytes: int) -> tuple[DataFrame, set[int]]:
    """The most frequent ids, as many as have titles of ``max_bytes``, and the positions in which other ids stand.

    An id that would fill a quarter of a partition or more at its position is among them in any case, known or not: there
    are at most four a partition and position. The counts are written down; only their sums by power of two are collected.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = df.select(F.posexplode(ids).alias("_pos", "_id")).filter(F.col("_id").isNotNull())
    counts = stored(flat.groupBy("_pos", "_id").agg(F.count("*").alias("_n")), "id-counts")
    power = F.floor(F.log2("_n")).cast("int")
    sums = counts.groupBy("_pos", power.alias("p")).agg(F.count("*").alias("ids"), F.sum("_n").alias("rows")).collect()
    size = names.agg(F.sum(row_bytes(names)).alias("bytes"), F.count("*").alias("n")).first()
    room, least = max_bytes * size["n"] // max(size["bytes"] or 0, 1), 64
    for p in sorted({r.p for r in sums}, reverse=True):
        room -= sum(r.ids for r in sums if r.p == p)
        if room < 0:
            break
        least = p
    rows = max((sum(r.rows for r in sums if r._pos == pos) for pos in {r._pos for r in sums}), default=0)
    often = (power >= least) | (F.col("_n") * (4 * parts) > F.lit(rows))
    others = {r[0] for r in counts.filter(~often).select("_pos").distinct().collect()}
    return counts.filter(often).select("_id").distinct(), others


def _resolve_exploded(df: DataFrame, key: str, ids: str, names: DataFrame, out: str, max_bytes: int) -> DataFrame:
    """Only key, position and id are exploded. The other columns stay in one row per key, and both meet in one shuffle by
    the hashes of ``key``; what is gathered is one row's own array. Titles go to all tasks if they are few bytes, else by
    :func:`spread_join`: an id that stands in every row is no hot key."""
    both = ["_h1", "_h2"]  # of the key, which may be wide
    hashed = df.withColumns({"_h1": F.xxhash64(key), "_h2": F.xxhash64(F.lit(1), key)})
    flat = hashed.select(*both, F.posexplode(ids).alias("_pos", "_id")).filter(F.col("_id").isNotNull())
    small = broadcast_if_small(names, max_bytes=max_bytes)
    named = spread_join(flat, names, "_id") if small is names else flat.join(small, "_id")
    rest = [c for c in df.columns if c != ids]
    own = hashed.select(*both, F.struct(*rest).alias("_rest"))  # a row's other columns, once
    parts = own.unionByName(named.select(*both, "_pos", "_title"), allowMissingColumns=True)
    pieces = F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_title")))
    titles = F.transform(F.array_sort(pieces), lambda s: s["_title"])
    return parts.groupBy(*both).agg(F.first("_rest", ignorenulls=True).alias("_rest"), titles.alias(out)).select(*(f"_rest.{c}" for c in rest), out)


def slug_join(
    df: DataFrame, title: str, index: DataFrame, index_title: str, columns: Mapping[str, Column]
) -> DataFrame:
    """Rows matched to an index by the slug of their titles; ``columns`` gives name -> default."""
    from duskboard.functions.text import slugify

    rows = index.withColumn("_slug", slugify(index_title)).groupBy("_slug").agg(F.min(F.struct(*columns)).alias("_i"))
    one = rows.select("_slug", *[F.col(f"_i.{c}").alias(f"_i_{c}") for c in columns])
    out = df.withColumn("_slug", slugify(title)).join(one, "_slug", "left")
    for c, default in columns.items():
        out = out.withColumn(c, F.coalesce(F.col(f"_i_{c}"), default)).drop(f"_i_{c}")
    return out.drop("_slug")


def slot_join(
    canonical: DataFrame, other: DataFrame, slot: Sequence[str], order: str, lang: str
) -> DataFrame:
    """Translations found by slot: the first row of the other language on the same slot, if it differs."""
    first = other.groupBy(*slot).agg(
        F.min_by("title", order).alias("other_title"), F.min_by("source_url", order).alias("other_url")
    )
    out = canonical.join(first, list(slot), "left")
    differs = F.col("other_title") != F.col("title")
    return (
        out.withColumn("lang", F.when(differs, F.lit(lang)))
        .withColumn("other_title", F.when(differs, F.col("other_title")))
        .withColumn("other_url", F.when(differs, F.col("other_url")))
    )


# Admission by weekday, Monday first, for the three pricing schemes of the sources.
WEEKDAY_PRICES = {
    "weekend": ["7€", "7€", "7€", "7€", "7€", "9€", "9€"],
    "viewer_day": ["6€", "6€", "6€", "4€", "6€", "8€", "8€"],
}


def weekday_price(date: Column | str, prices: Sequence[str | None]) -> Column:
    """Price of the date's weekday; a missing Sunday shares the Saturday tier."""
    tiers = list(prices) + [None] * (7 - len(prices))
    if tiers[6] is None:
        tiers[6] = tiers[5]
    d = F.col(date) if isinstance(date, str) else date
    return F.element_at(F.array(*[F.lit(p).cast("string") for p in tiers]), F.weekday(d) + 1)


def with_default(df: DataFrame, dim: DataFrame, key: str, col: str) -> DataFrame:
    """Rows without a value take their venue's default."""
    default = dim.select(key, F.col(col).alias("_default"))
    return df.join(default, key, "left").withColumn(col, F.coalesce(col, "_default")).drop("_default")


def unknown_categories(batch: DataFrame, categories: DataFrame) -> DataFrame:
    """Staged category slugs, per venue, that the category table does not know."""
    staged = batch.select("venue_slug", F.explode("category_slugs").alias("slug")).distinct()
    return staged.join(categories.select("slug"), "slug", "left_anti")


def page_keys(lists: DataFrame, locales: Sequence[str], author: str = "house") -> DataFrame:
    """Every (locale, list) page of the house lists."""
    return lists.filter(F.col("author") == author).select(
        F.explode(F.array(*[F.lit(x) for x in locales])).alias("locale"), F.col("slug").alias("list_slug")
    )
