import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from duskboard.functions.categories import category_name, display_price
from duskboard.operators import agenda as G
from duskboard.operators import ranking as K
from duskboard.operators.expand import expand_showtimes, expand_weekly
from duskboard.operators.joins import list_events, localize, localize_all

TODAY = dt.date(2026, 6, 8)


def one_page(spark, times, date=TODAY):
    rows = [(i, f"t{i}", date, t, t, 0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, title string, start_date date, start_time string, event_start_time string, session_pos int")
    return G.with_day(df)


def test_late_night_belongs_to_the_evening_before(spark):
    day = G.day_agenda(one_page(spark, ["00:30", "05:00", None, "23:00"]), TODAY)
    assert sorted(r.event_id for r in day.collect()) == [1, 2, 3]
    counts = {r.logical_date: r.n for r in G.day_counts(one_page(spark, ["00:30", "05:00", None])).collect()}
    assert counts == {TODAY - dt.timedelta(days=1): 1, TODAY: 2}


def test_list_whitelist_overlap_and_lookback(spark):
    lists = spark.createDataFrame([(1, "film"), (2, "all")], "list_id long, slug string")
    members = spark.createDataFrame([(1, 10, 7), (1, 10, 7), (2, 10, None), (2, 10, 7)], "list_id long, venue_id long, whitelist_category_id long")
    venues = spark.createDataFrame([(10, "V")], "venue_id long, name string")
    events = spark.createDataFrame([(100, 10), (101, 10), (102, 10)], "event_id long, venue_id long")
    cats = spark.createDataFrame([(100, 7), (100, 8), (101, 8)], "event_id long, category_id long")
    got = sorted((r.list_slug, r.event_id) for r in list_events(lists, members, venues, events, cats).collect())
    assert got == [("all", 100), ("all", 101), ("all", 102), ("film", 100)]


def test_each_column_falls_back_on_its_own(spark):
    events = spark.createDataFrame([(1, "A", "u1"), (2, "B", "u2")], "event_id long, title string, source_url string")
    tr = spark.createDataFrame([(1, "es", "Aes", None), (1, "en", "Aen", "u1en")], "event_id long, lang string, title string, source_url string")
    assert sorted(tuple(r) for r in localize(events, tr, "es").select("event_id", "title", "source_url").collect()) == [(1, "Aes", "u1"), (2, "B", "u2")]
    both = localize_all(events, tr, ["ca", "es", "en"]).select("event_id", "locale", "title", "source_url")
    assert sorted(tuple(r) for r in both.collect()) == [
        (1, "ca", "A", "u1"), (1, "en", "Aen", "u1en"), (1, "es", "Aes", "u1"), (2, "ca", "B", "u2"), (2, "en", "B", "u2"), (2, "es", "B", "u2")]


def test_showtimes(spark):
    df = spark.createDataFrame([(1, "19:00", ["21:00:00", "19:00:00"]), (2, "18:00", []), (3, None, None)], "event_id long, start_time string, start_times array<string>")
    got = [(r.event_id, r.session_pos, r.start_time) for r in expand_showtimes(df).orderBy("event_id", "session_pos").collect()]
    assert got == [(1, 0, "21:00"), (1, 1, "19:00"), (2, 0, "18:00"), (3, 0, None)]


def test_weekly_template_two_weeks(spark):
    template = spark.createDataFrame([(0, "open mic"), (4, "jam"), (4, "dj"), (6, "brunch")], "weekday int, title string")
    got = expand_weekly(template, dt.date(2026, 6, 1), 14).collect()
    assert len(got) == 8 and all(r.start_date.weekday() == r.weekday for r in got)
    assert expand_weekly(template, dt.date(2026, 8, 1), 14, skip_months=[8]).count() == 0


def hidden(spark, times, now):
    rows = G.early_hidden(one_page(spark, times), now).collect()
    return sorted(r.event_id for r in rows if r.hidden)


def test_early_rows_hide_only_when_something_remains(spark):
    at = dt.datetime(2026, 6, 8, 21, 10)
    assert hidden(spark, ["16:00", "19:00", "19:30", None], at) == [0, 1, 3]
    assert hidden(spark, ["16:00", "17:00"], at) == []
    assert hidden(spark, ["20:00", "22:00"], at) == []


def test_dawn_counts_the_day_as_early(spark):
    # Between 05:00 and 07:00 two hours ago is a small hour, which sorts after the whole day.
    assert hidden(spark, ["06:00", "12:00"], dt.datetime(2026, 6, 8, 6, 10)) == []
    late = one_page(spark, ["12:00"]).unionByName(one_page(spark, ["04:30"], TODAY + dt.timedelta(days=1)).withColumn("event_id", F.lit(9).cast("long")))
    rows = G.early_hidden(late, dt.datetime(2026, 6, 8, 6, 10)).collect()
    assert [r.event_id for r in rows if r.hidden] == [0]


def test_now_marker(spark):
    at = dt.datetime(2026, 6, 8, 18, 0)
    (r,) = G.now_marker(one_page(spark, ["16:00", "18:00", "19:00", None]), at).collect()
    assert (r.marker_row, r.all_past) == (3, False)
    (r,) = G.now_marker(one_page(spark, ["16:00"]), at).collect()
    assert (r.marker_row, r.all_past) == (1, True)
    (r,) = G.film_now_marker(one_page(spark, ["16:00"]), at, F.col("title")).collect()
    assert (r.marker_row, r.all_past) == (0, True)


def test_positions_of_a_hot_group_match_a_plain_window(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", rnd.choice(["a", "b", None]), rnd.randrange(10**6), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, slot string, id long, tie long")
    got = K.index_within(df, ["k"], ["slot"], "id", ["tie"])
    plain = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("slot", "id", "tie")) - 1)
    assert got.count() == 5000
    assert got.join(plain, ["tie"]).filter("idx != want").count() == 0


def test_first_row_per_key_whatever_the_partitioning(spark):
    df = spark.range(1000).selectExpr("id % 7 as k", "id as pos", "concat('v', id) as v")
    want = sorted((k, f"v{k}") for k in range(7))
    for n in (1, 5):
        assert sorted((r.k, r.v) for r in K.keep_first(df.repartition(n), ["k"], ["pos"]).collect()) == want


def test_list_order(spark):
    lists = spark.createDataFrame([("pop", "house"), ("film", "house"), ("club", "house"), ("jazz", "house"), ("x", "guest")], "slug string, author string")
    assert [(r.slug, r.primary) for r in G.order_lists(lists).collect()] == [("jazz", True), ("film", True), ("club", False), ("pop", False)]


def test_labels(evaluate):
    assert evaluate(lambda c: category_name(c, F.lit("es")), ["film", "opera"]) == ["Cine", "opera"]
    assert evaluate(lambda c: display_price(c, F.lit("ca")), ["free", "sold-out", "12€", None]) == ["Gratuït", "Exhaurit", "12€", ""]
