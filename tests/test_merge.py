import datetime as dt
import inspect
import re
import uuid

import pytest
from pyspark.sql import functions as F

from duskboard.operators import merge as M
from duskboard.operators import quality as Q
from duskboard.schemas import STAGING, validate_schema

D0 = dt.date(2026, 6, 8)
NOW = dt.datetime(2026, 6, 7, 2)


def staged(spark, rows):
    base = {f: None for f in STAGING.names}
    base.update(venue_slug="v", source_url="u", category_slugs=["jazz"], start_times=[], annotations=[], translations=[])
    data = [tuple({**base, "pos": i, "start_date": D0, **r}[f] for f in STAGING.names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, STAGING)


def store(spark, rows=()):
    """A snapshot made by a first upsert into nothing, its ids replaced by small ones."""
    empty = staged(spark, []).withColumn("event_id", F.lit(None).cast("long"))
    snap = M.upsert(staged(spark, list(rows)), empty, dt.datetime(2026, 1, 1)).drop("change")
    if not rows:
        return snap
    numbered = {r.title: i for i, r in enumerate(sorted(snap.collect(), key=lambda r: r.title), start=1)}
    ids = F.create_map(*[F.lit(x) for kv in numbered.items() for x in kv])
    return snap.withColumn("event_id", ids[F.col("title")].cast("long"))


def result(df):
    return sorted((r.change, r.title, r.external_id, r.source_url, r.start_date, r.event_id if r.change != "inserted" else None) for r in df.collect())


def test_reschedule_updates_in_place(spark):
    cur = store(spark, [dict(title="A", external_id="1", source_url="a")])
    out = M.upsert(staged(spark, [dict(title="A", external_id="1", source_url="a", start_date=dt.date(2026, 7, 1))]), cur, NOW)
    assert result(out) == [("updated", "A", "1", "a", dt.date(2026, 7, 1), 1)]


def test_tiers(spark):
    cur = store(spark, [dict(title="A", external_id="1", source_url="a"), dict(title="B", source_url="b"), dict(title="C", source_url="c")])
    batch = staged(spark, [
        dict(title="A", external_id="2", source_url="a"),  # another id is another event, whatever its URL
        dict(title="B2", source_url="b"),  # URL
        dict(title="C", source_url="c2"),  # title and date
        dict(title="D", source_url="d"),  # new
    ])
    assert result(M.upsert(batch, cur, NOW)) == [
        ("inserted", "A", "2", "a", D0, None), ("inserted", "D", None, "d", D0, None), ("kept", "A", "1", "a", D0, 1),
        ("updated", "B2", None, "b", D0, 2), ("updated", "C", None, "c2", D0, 3)]


def test_id_less_row_takes_over_a_row_with_an_id(spark):
    cur = store(spark, [dict(title="A", external_id="1", source_url="a")])
    assert result(M.upsert(staged(spark, [dict(title="A", source_url="a")]), cur, NOW)) == [("updated", "A", None, "a", D0, 1)]


def test_rows_of_one_url_are_one_event_and_the_last_stays(spark):
    cur = store(spark, [dict(title="A", source_url="old")])
    batch = staged(spark, [dict(title="A", source_url="x"), dict(title="A bis", source_url="x")])
    assert result(M.upsert(batch, cur, NOW)) == [("updated", "A bis", None, "x", D0, 1)]


def test_same_title_and_date_under_two_urls(spark):
    # Both are new: one event. When one of them is known by its URL, the other stays its own event.
    batch = staged(spark, [dict(title="T", source_url="x"), dict(title="T", source_url="y")])
    assert len(M.upsert(batch, store(spark), NOW).collect()) == 1
    cur = store(spark, [dict(title="Old", source_url="y")])
    assert result(M.upsert(batch, cur, NOW)) == [("inserted", "T", None, "x", D0, None), ("updated", "T", None, "y", D0, 1)]


def test_earliest_session_is_the_start(spark):
    out = M.upsert(staged(spark, [dict(title="A", start_time="23:00", start_times=["21:00", "19:00"])]), store(spark), NOW)
    assert [r.start_time for r in out.collect()] == ["19:00"]


def test_upsert_is_idempotent_and_order_free(spark):
    rows = [dict(title=f"T{i % 9}-{i % 2}", external_id=None if i % 2 else f"e{i}", source_url=f"u{i % 13}-{i % 2}") for i in range(40)]
    batch, cur = staged(spark, rows), store(spark, [dict(title="T1-1", source_url="u1-1"), dict(title="Z", source_url="z")])
    once = M.upsert(batch, cur, NOW).drop("change")
    twice = M.upsert(batch, once, NOW).drop("change")
    key = lambda df: sorted((r.event_id, r.title, r.external_id or "", r.source_url) for r in df.collect())
    assert key(once) == key(twice)
    assert key(M.upsert(batch.repartition(7), cur.repartition(3), NOW)) == key(once)


def test_translations_are_updated_added_and_removed(spark):
    stored = spark.createDataFrame([(1, "es", "a"), (1, "en", "b"), (2, "es", "c")], "event_id long, lang string, title string").selectExpr(
        "*", "cast(null as string) description", "cast(null as string) source_url")
    targets = spark.createDataFrame(
        [(1, [("es", "A", None, None), ("fr", "F", None, None)])], "event_id long, translations array<struct<lang:string,title:string,description:string,source_url:string>>")
    assert sorted((r.event_id, r.lang, r.title) for r in M.merge_translations(targets, stored).collect()) == [(1, "es", "A"), (1, "fr", "F"), (2, "es", "c")]
    assert [tuple(r) for r in M.stale_translations(targets, stored).collect()] == [(1, "en")]


def test_a_bad_row_fails_its_venue_only(spark):
    venues = spark.createDataFrame([("v",), ("w",), ("x",), ("y",)], "slug string")
    cats = spark.createDataFrame([("jazz",)], "slug string")
    batch = staged(spark, [
        dict(title="A", external_id="1"), dict(title="B", external_id="1"), dict(title="C", venue_slug="w"),
        dict(title="D", venue_slug="x", category_slugs=["poetry"]), dict(title=" ", venue_slug="y"), dict(title="E", venue_slug="nowhere")])
    fails = Q.validate(batch, venues, cats)
    assert sorted(tuple(r) for r in fails.collect()) == [
        ("nowhere", "unknown_venue"), ("v", "duplicate_external_id"), ("x", "unknown_category"), ("y", "missing_field")]
    good, bad = Q.split_valid(batch, fails)
    assert [r.title for r in good.collect()] == ["C"] and bad.count() == 5


def test_seed_is_idempotent(spark):
    cur = spark.createDataFrame([(1, 1, None), (1, 2, 7)], "list_id long, venue_id long, whitelist_category_id long")
    more = spark.createDataFrame([(1, 1, None), (1, 1, 7)], "list_id long, venue_id long, whitelist_category_id long")
    once = M.merge_memberships(more, cur)
    assert once.count() == 3 and M.merge_memberships(more, once).count() == 3
    dims = spark.createDataFrame([(1, "a", "old")], "id long, slug string, name string")
    defs = spark.createDataFrame([("a", "new"), ("b", "B")], "slug string, name string")
    assert sorted((r.id, r.slug, r.name) for r in M.merge_dims(defs, dims, update=["name"]).collect()) == [(1, "a", "new"), (2, "b", "B")]


def test_new_dimensions_get_ids(spark):
    dims = spark.createDataFrame([(7, "a", "A"), (40, "b", "B")], "id long, slug string, name string")
    defs = spark.createDataFrame([(f"v{i}", f"V{i}") for i in range(300)] + [("v5", "U5"), ("b", "x")], "slug string, name string")
    ids = lambda df: {r.slug: (r.id, r.name) for r in df.collect()}
    got = ids(M.merge_dims(defs, dims))
    assert got == ids(M.merge_dims(defs.repartition(7, "name"), dims.repartition(2)))
    assert got["a"] == (7, "A") and got["b"] == (40, "B") and got["v5"][1] == "U5"
    assert sorted(i for i, _ in got.values()) == [7, 40, *range(41, 341)]
    # A second seed changes no id, and new rows come behind.
    merged = M.merge_dims(defs, dims)
    stored = spark.createDataFrame(merged.collect(), merged.schema)
    again = ids(M.merge_dims(spark.createDataFrame([("v3", "V3"), ("new", "N")], "slug string, name string"), stored))
    assert again["new"][0] == 341 and {k: v for k, v in again.items() if k != "new"} == got
    # Events of a new venue find it.
    events = spark.createDataFrame([(1, "v9")], "event_id long, slug string")
    assert events.join(merged, "slug").filter("id IS NOT NULL").count() == 1
    none = M.merge_dims(defs.limit(3), dims.limit(0))
    assert sorted(r.id for r in none.collect()) == [1, 2, 3]


def test_schema_check(spark):
    ok = staged(spark, [dict(title="A")])
    assert validate_schema(ok.drop("image_url")).schema == STAGING
    with pytest.raises(ValueError, match="missing"):
        validate_schema(ok.drop("title"))
    with pytest.raises(ValueError, match="type"):
        validate_schema(ok.withColumn("start_date", F.lit("2026-01-01")))
    with pytest.raises(ValueError, match="outside"):
        validate_schema(ok.withColumn("x", F.lit(1)))


def test_an_old_text_does_not_bring_back_an_old_id(spark):
    """A row changes its key and a new row comes with the key it had: two events, two ids, also within one time."""
    empty = spark.createDataFrame([], store(spark).schema)
    steps = [("1", "A", None, "u1"), ("2", "B", None, "u1"), ("1", "A", "9", "u3")]
    snap = empty
    for version, title, external, url in steps:
        out = M.upsert(staged(spark, [dict(title=title, external_id=external, source_url=url)]), snap, NOW, version).drop("change")
        snap = spark.createDataFrame(out.collect(), out.schema)
    ids = [r.event_id for r in snap.collect()]
    assert len(ids) == len(set(ids)) == 2


def test_the_last_of_equal_languages_wins(spark):
    rows = spark.createDataFrame([(1, 0, "es", "z", None, None), (1, 1, "es", "a", None, None)], "event_id long, pos int, lang string, title string, description string, source_url string")
    assert [(r.lang, r.title) for r in M.keep_last_per_language(rows).collect()] == [("es", "a")]


def test_positions_of_minted_and_serial_ids(spark):
    from duskboard.operators.ranking import index_within

    ids = [-(2**63) + 5, -(2**62), -7, 0, 1, 2, 3, 100, 2**62]
    df = spark.createDataFrame([(0, 0, i) for i in reversed(ids)], "day int, coarse int, id long")
    got = {r.id: r.idx for r in index_within(df, ["day"], ["coarse"], "id").collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_far_off_ids_leave_cells_even(spark):
    from duskboard.operators.ranking import index_within, with_balanced_cell

    ids = [*range(5000), 10**15, -(10**17), None]
    df = spark.createDataFrame([(i % 3, i) if i is not None else (0, None) for i in ids], "day int, id long")
    sizes = [r["count"] for r in with_balanced_cell(df, df, "id").groupBy("_cell").count().collect()]
    assert max(sizes) < 0.03 * len(ids)
    got = {(r.day, r.id): r.idx for r in index_within(df, ["day"], [], "id").collect()}
    for day in range(3):
        own = sorted((i for d, i in got if d == day), key=lambda i: (i is not None, i or 0))
        assert [got[day, i] for i in own] == list(range(len(own)))


def test_children_follow_the_matched_event(spark):
    """Categories and translations of a matched event are replaced, those of others kept; they round-trip through their tables."""
    one = lambda lang, title: (lang, title, None, None)
    cur = store(spark, [dict(title="A", external_id="1", source_url="a", category_slugs=["folk"], translations=[one("es", "a"), one("en", "a")]),
                        dict(title="B", source_url="b", category_slugs=["jazz", "folk", "jazz"], translations=[one("fr", "b")])])
    cats = spark.createDataFrame([(1, "jazz"), (2, "folk")], "category_id long, slug string")
    whole = M.with_children(cur, M.category_rows(cur, cats), cats, M.translation_rows(cur))
    kids = lambda df: {r.title: (r.category_slugs, [(t.lang, t.title) for t in r.translations]) for r in df.collect()}
    assert kids(whole) == kids(cur)
    batch = staged(spark, [dict(title="A2", external_id="1", source_url="a", category_slugs=["jazz", None], translations=[one("es", "z"), one("es", "y"), one(None, "x")]),
                           dict(title="C", source_url="c", category_slugs=None, translations=None)])
    assert kids(M.upsert(batch, whole, NOW)) == {
        "A2": (["jazz"], [("es", "y")]), "B": (["folk", "jazz"], [("fr", "b")]), "C": ([], [])}


def test_a_new_row_meets_its_id_in_the_store(spark):
    """The id a new row is hashed to may be stored: the event stays as it is, or as another row of the batch writes it."""
    row = dict(title="A", source_url="u")
    first = M.upsert(staged(spark, [row]), store(spark), NOW, "1").drop("change").collect()
    other = M.upsert(staged(spark, [row]), store(spark), NOW, "2").first().event_id
    schema = store(spark).schema
    moved = spark.createDataFrame([{**first[0].asDict(), "title": "B", "source_url": "w"}], schema)
    got = lambda df: sorted((r.change, r.title, r.source_url, r.event_id == first[0].event_id) for r in df.collect())
    out = M.upsert(staged(spark, [row]), moved, NOW, "1")
    assert got(out) == [("inserted", "A", "u", False), ("kept", "B", "w", True)]
    assert out.filter("change = 'inserted'").first().event_id not in (other, first[0].event_id)
    both = M.upsert(staged(spark, [row, dict(title="B2", source_url="w")]), moved, NOW, "1")
    assert got(both) == [("inserted", "A", "u", False), ("updated", "B2", "w", True)]


def test_rows_are_shuffled_by_keys_and_id_only(spark):
    """Rows of the batch move to their first key, those without an id to their second, and all to the event's id, which is no
    null; the store moves by id. Venues are sent to all tasks when they are known to be few."""
    cur = store(spark, [dict(title="A", external_id="1", source_url="a"), dict(title="B", source_url="b", venue_slug="w")])
    batch = staged(spark, [dict(title="A2", external_id="1", source_url="a"), dict(title="N", source_url="n")])
    path = f"/tmp/test-merge-{uuid.uuid4().hex}"
    cur.write.parquet(f"{path}/current")
    batch.write.parquet(f"{path}/batch")
    cur, batch = spark.read.parquet(f"{path}/current"), spark.read.parquet(f"{path}/batch")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        venues = spark.createDataFrame([("v",), ("w",)], "slug string")
        out = M.upsert(batch, cur, NOW, **({"venues": venues} if "venues" in inspect.signature(M.upsert).parameters else {}))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert result(out) == [("inserted", "N", None, "n", D0, None), ("kept", "B", None, "b", D0, 2), ("updated", "A2", "1", "a", D0, 1)]
    by = [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\((.*), 3\)", plan)]
    assert not [x for x in by if x in ("venue_slug", "_key", "_minted")], by
    # Four by two keys each beside the stored keys' three, two by id; the distinct venues of the batch are no rows of it.
    assert len([x for x in by if x != "_venue"]) <= 8, by
