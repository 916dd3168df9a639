import datetime as dt
import shutil

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_merge import staged, store

from duskboard.operators import extract as X
from duskboard.operators import sequences as S
from duskboard.operators.merge import upsert
from duskboard.sources.feeds import Field, explode_entries, feed_entries, localized, parse_documents, parse_feed, read_fields
from duskboard.streaming import upserts
from duskboard.streaming.upserts import init_store, read_store, upsert_stream, written_versions

NOW = dt.datetime(2026, 6, 7, 2)


def test_jsonld_skips_broken_scripts(spark):
    good = '<script type="application/ld+json">[{"@type":"Event","name":"A","offers":{"price":12}},{"@type":"Place","name":"P"}]</script>'
    one = '<script type="application/ld+json">{"@type":"Event","name":"B"}</script>'
    pages = spark.createDataFrame([(1, good + '<script type="application/ld+json">{broken</script>' + one), (2, "<p>none</p>")], "page_id long, html string")
    got = sorted((r.page_id, r.item.name, r.item.offers.price if r.item.offers else None) for r in X.extract_jsonld(pages).collect())
    assert got == [(1, "A", "12"), (1, "B", None)]


def test_blocks_links_and_classes(spark):
    html = '<li class="x">a<a href="/s/1">1</a></li><li class="x">b<a href="/s/2">2</a><a href="/s/1">1</a></li>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.pos, X and r.block[-10:]) for r in X.extract_blocks(pages, '<li class="x">').orderBy("pos").collect()] == [(0, "1</a></li>"), (1, "1</a></li>")]
    assert [(r.pos, r.href) for r in X.extract_links(pages, "/s/").orderBy("pos").collect()] == [(0, "/s/1"), (1, "/s/2")]
    (r,) = X.class_tokens(spark.createDataFrame([("card 2026-06-10 20:30:00 id_330 dis_7",)], "css string"), "css").collect()
    assert (r.class_date, r.class_time, r.class_id, r.class_genre, r.class_session) == (dt.date(2026, 6, 10), "20:30", 330, 7, None)


def test_cards_in_cards(spark):
    inner = '<div class="card s"><div>20:30</div></div>'
    film = f'<DIV title="a > b" class="card f"><div><b>T</div>{inner}<img src="x"/>{inner}</DIV>'
    pages = {
        1: f'</div><!-- <div class="card x"> --><div>{film}<script>"</div><div class=\'card \'>"</script>{film}</div>',
        2: '<div class="card a"><div class="card b"><p>never closed', 3: "no cards", 4: "", 5: None, 6: '<div class="card e"/><divider class="card no"></divider>',
    }
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = sorted((r.page_id, r.pos, r.parent, r.depth, r.block) for r in X.extract_elements(df, "div", 'class="card ').collect())
    assert got == [
        (1, 0, None, 0, film), (1, 1, 0, 1, inner), (1, 2, 0, 1, inner), (1, 3, None, 0, film), (1, 4, 3, 1, inner), (1, 5, 3, 1, inner),
        (2, 0, None, 0, pages[2]), (2, 1, 0, 1, '<div class="card b"><p>never closed'), (6, 0, None, 0, '<div class="card e"/>'),
    ]


def test_a_page_of_many_cards(spark):
    html = "".join(f'<div class="card c{i}">' + "<div>" * 20 + "é" * 50 + "</div>" * 20 + "</div>" for i in range(700))
    found = X.extract_elements(spark.createDataFrame([(html,)], "html string"), "div", 'class="card ').collect()
    assert len(found) == 700 and "".join(r.block for r in sorted(found, key=lambda r: r.pos)) == html


def test_schedule(spark):
    lines = [("intro", "x"), ("12/06 20:30H", "ANNA TRIO"), ("", "soul"), ("8 €", "and more"), ("22H", ""), ("", "LATE JAM"), ("& 23H", "second set"),
             ("13/06 21H", "SOLO"), ("piano", "")]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(lines)], "doc_id long, line_no long, left_text string, right_text string")
    got = [(r.day_text, r.start_time, r.title, r.price, r.description) for r in X.schedule_segments(df).orderBy("start_line").collect()]
    assert got == [("12/06", "20:30", "ANNA TRIO", "8€", "soul and more"), ("12/06", "22:00", "LATE JAM", None, "second set"),
                   ("13/06", "21:00", "SOLO", None, "piano")]


def test_reading_order(spark):
    rows = spark.createDataFrame([(1, 0, None, 30), (1, 1, "a", 31), (1, 2, None, 1), (1, 3, "b", 31), (2, 0, None, 5)], "page_id long, pos int, h string, day int")
    fill = [r.h for r in S.forward_fill(rows, "h").orderBy("page_id", "pos").collect()]
    back = [r.h for r in S.backward_fill(rows, "h").orderBy("page_id", "pos").collect()]
    assert fill == [None, "a", "a", "b", None] and back == ["a", "a", "b", "b", None]
    dated = S.roll_months(rows.withColumn("m", F.lit(dt.date(2026, 12, 1))), "m").orderBy("page_id", "pos").collect()
    d = dt.date
    assert [r.date for r in dated] == [d(2026, 12, 30), d(2026, 12, 31), d(2027, 1, 1), d(2027, 1, 31), d(2026, 12, 5)]


def test_one_long_page_reads_like_a_short_one(spark):
    """A page far longer than one range: fills and month changes cross the cuts."""
    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 17 == 0, 2).otherwise(1).alias("page_id"), F.col("id").alias("pos"),
        F.when(F.col("id") % 1501 == 3, F.col("id").cast("string")).alias("h"), (1 + F.col("id") * 7 % 28).alias("day"),
        F.lit(dt.date(2026, 1, 1)).alias("m"))
    w = Window.partitionBy("page_id").orderBy("pos")
    plain = rows.select(
        "page_id", "pos",
        F.last("h", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("down"),
        F.first("h", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("up"),
        F.when(F.col("day") < F.lag("day").over(w), 1).otherwise(0).alias("wrap"), "day", "m")
    months = F.sum("wrap").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    plain = plain.withColumn("date", F.date_add(F.add_months("m", months), F.col("day").cast("int") - 1))

    def rows_of(df, col):
        return sorted((r.page_id, r.pos, str(r[col])) for r in df.select("page_id", "pos", col).collect())

    assert rows_of(S.forward_fill(rows, "h"), "h") == rows_of(plain, "down")
    assert rows_of(S.backward_fill(rows, "h"), "h") == rows_of(plain, "up")
    assert rows_of(S.roll_months(rows, "m"), "date") == rows_of(plain, "date")


def test_keyed_feed(spark):
    df = spark.createDataFrame([(1, '{"a":{"t":"x"},"b":{"t":null}}'), (2, "{bad")], "id int, doc string")
    parsed = parse_feed(df, "doc", "map<string,struct<t:string>>").drop("doc")
    assert sorted((r.id, r.entry_id, r.entry.t) for r in feed_entries(parsed, "feed").collect()) == [(1, "a", "x"), (1, "b", None)]


def test_feed_of_changing_shape(spark):
    docs = {
        1: '{"show":{"title":{"ca":"A","es":"B"},"free":"0","n":"7"}}', 2: '{"show":{"title":{"ca":"","es":" B "},"free":true,"n":1.5}}',
        3: '{"show":{"title":"C","free":{"x":1},"n":[2]}}', 4: '{"show":{"title":{"en":"D"}}}', 5: '[{"x":', 6: None, 7: '"text"', 8: "null", 9: "",
    }
    df = spark.createDataFrame(list(docs.items()), "id int, doc string")
    good, broken = parse_documents(df, "doc")
    fields = {"title": localized("$.show.title"), "free": Field("flag", ("$.show.free",)), "n": Field("number", ("$.show.n", "$.show.m"))}
    got = {r.id: (r.title, r.free, r.n) for r in read_fields(good, "document", fields).collect()}
    assert got == {1: ("A", False, 7.0), 2: ("B", True, 1.5), 3: ("C", False, None), 4: (None, False, None), 7: (None, False, None), 8: (None, False, None)}
    assert sorted((r.id, r.reason) for r in broken.collect()) == [(5, "not JSON"), (6, "no text"), (9, "not JSON")]


def test_entries_by_id_or_in_a_list(spark):
    docs = {1: '{"s":{"a":{"v":1},"b":{"v":2}}}', 2: '{"s":[{"v":3},null]}', 3: '{"s":"soon"}', 4: "{}", 5: '{"s":[]}', 6: '{"s":null}'}
    good, _ = parse_documents(spark.createDataFrame(list(docs.items()), "id int, doc string"), "doc")
    rows = read_fields(explode_entries(good, "document", "$.s"), "entry", {"v": Field("number", ("$.v",))})
    assert sorted(((r.id, r.entry_pos, r.entry_id, r.v) for r in rows.collect())) == [(1, 0, "a", 1.0), (1, 1, "b", 2.0), (2, 0, None, 3.0), (2, 1, None, None)]


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    rows = [dict(title=f"T{i}", venue_slug=f"v{i % 4}", external_id=f"e{i}" if i % 3 else None, source_url=f"u{i}",
                 translations=[("es", f"E{i}", None, None)] * (i % 2)) for i in range(24)]
    rows += [dict(title="dup", venue_slug="v3", external_id="e1x"), dict(title="dup", venue_slug="v3", external_id="e1x")]
    batch = staged(spark, rows)
    cur = store(spark, [dict(title="T1", venue_slug="v1", external_id="e1", source_url="u1"), dict(title="K", venue_slug="v9", source_url="k")])
    venues = spark.createDataFrame([(f"v{i}",) for i in range(10)], "slug string")
    cats = spark.createDataFrame([("jazz",)], "slug string")
    base = str(tmp_path)
    for v in range(4):
        batch.filter(F.col("venue_slug") == f"v{v}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    init_store(cur, f"{base}/store")
    args = (spark, f"{base}/in", f"{base}/store", f"{base}/cp", venues, cats, NOW)
    upsert_stream(*args, files_per_batch=1, tracked=False).awaitTermination()
    # New ids carry the micro-batch: other than the batch job's, but unique, and the same on a rerun.
    rows_of = lambda df: sorted((r.event_id, r.venue_slug, r.title, r.external_id or "", r.category_slugs, r.translations) for r in df.collect())
    named = lambda rows: sorted((max(i, 0), *rest) for i, *rest in rows)
    first = rows_of(read_store(spark, f"{base}/store"))
    assert named(first) == named(rows_of(upsert(batch.filter("venue_slug != 'v3'"), cur, NOW)))
    assert len({i for i, *_ in first}) == len(first)
    # Progress is lost after the last commit: every batch runs again over what is there.
    shutil.rmtree(f"{base}/cp")
    upsert_stream(*args, files_per_batch=1, tracked=False).awaitTermination()
    assert rows_of(read_store(spark, f"{base}/store")) == first


def test_a_store_stays_cheap_to_read(spark, tmp_path, monkeypatch):
    """More micro-batches than lie between two whole versions: the stream has what the batch jobs give, one after
    the other, and a reader opens no version before the last whole one."""
    monkeypatch.setattr(upserts, "WHOLE_EVERY", 3)
    base, last = str(tmp_path), 4
    cur = store(spark, [dict(title="K", venue_slug="v9", source_url="k", category_slugs=["jazz"], translations=[("es", "EK", None, None)])])
    venues = spark.createDataFrame([(f"v{i}",) for i in range(10)], "slug string")
    cats = spark.createDataFrame([("jazz",), ("folk",)], "slug string")
    init_store(cur, f"{base}/store")
    for i in range(last):
        rows = [dict(title="A", venue_slug=f"v{i % 3}", source_url="a", category_slugs=["folk", "jazz", "folk"][i % 2:],
                     translations=[("es", f"old{i}", None, None), ("en", "N", None, None), ("es", f"E{i}", None, None)][i % 2:])]
        staged(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    upsert_stream(spark, f"{base}/in", f"{base}/store", f"{base}/cp", venues, cats, NOW, files_per_batch=1, tracked=False).awaitTermination()
    got = read_store(spark, f"{base}/store")
    told = {(r.venue_slug, r.title): (r.category_slugs, [(t.lang, t.title) for t in r.translations]) for r in got.collect()}
    assert len(told) == 4 and told["v9", "K"] == (["jazz"], [("es", "EK")])
    assert told[f"v{(last - 1) % 3}", "A"] == (["folk", "jazz"], [("en", "N"), ("es", f"E{last - 1}")])
    assert told[f"v{(last - 2) % 3}", "A"] == (["folk", "jazz"], [("en", "N"), ("es", f"E{last - 2}")])
    assert written_versions(spark, f"{base}/store") == list(range(last + 1))
    assert {f.split("version=")[1].split("/")[0] for f in got.inputFiles()} == {"3", "4"}


def test_lines_of_whole_pages_are_those_of_their_words(spark):
    """Pages in one row, in several, without an id, without words; the words of whole pages are not shuffled."""
    word = lambda x, y, w: {"left_px": x, "top_px": y, "word": w}
    data = [(1, [word(400, 3, "r"), word(80, 19, "b"), word(0, 0, "a"), word(0, 45, "c c")]), (2, [word(80, 0, "y")]), (2, [word(0, 5, "x"), word(480, 5, "z")]),
            (None, [word(0, 0, "n")]), (None, [word(80, 0, "m")]), (3, []), (4, None)]
    pages = spark.createDataFrame(data, "doc_id long, words array<struct<left_px: long, top_px: long, word: string>>")
    told = lambda df: sorted((r.doc_id or 0, r.line_no, r.left_text, r.right_text) for r in df.collect())
    got = told(X.page_lines(pages))
    assert got == [(0, 0, "n m", ""), (1, 0, "a b", "r"), (1, 2, "c c", ""), (2, 0, "x y", "z")]
    assert got == told(X.reconstruct_lines(pages.select("doc_id", X.F.inline("words"))))
    plan = X.page_lines(pages.filter("doc_id = 1"))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
