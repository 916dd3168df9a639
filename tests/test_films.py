import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskboard.operators import packing
from duskboard.operators.agenda import with_day
from duskboard.operators.films import balance_columns, film_groups, film_showtimes
from duskboard.operators.packing import pack, place, total_rows

DAY = dt.date(2026, 6, 8)


def agenda(spark, rows):
    data = [(i, title, DAY, time, time, 0, "Sala") for i, title, time in rows]
    schema = "event_id long, title string, start_date date, start_time string, event_start_time string, session_pos int, venue_name string"
    return with_day(spark.createDataFrame(data, schema))


def test_variants_of_a_title_are_one_film(spark):
    films = film_groups(agenda(spark, [(1, "La Boira [VOSE]", "17:10"), (2, "LA BOIRA", "22:05"), (3, "Vent (Nord)", "19:40"), (4, "la boira", "19:00")]))
    got = {r.title: (r.n_showtimes, r.earliest_key, r.latest_time, r.height) for r in films.collect()}
    assert set(got.values()) == {(3, "117:10", "22:05", 4), (1, "119:40", "19:40", 2)}
    assert {t.lower() for t in got} == {"la boira", "vent (nord)"}


def test_showtimes_are_sorted_with_the_small_hours_last(spark):
    rows = agenda(spark, [(1, "Boira", "21:45"), (2, "Boira", "02:30"), (3, "Boira", "11:00"), (4, "Boira", None)])
    # 02:30 of this date belongs to the evening before.
    got = sorted((r.logical_date, r.showtime_no, r.start_time) for r in film_showtimes(rows).collect())
    assert got == [(DAY - dt.timedelta(days=1), 0, "02:30"), (DAY, 0, None), (DAY, 1, "11:00"), (DAY, 2, "21:45")]


def test_cards_are_placed_as_the_rule_says(spark):
    """Each card goes to the lowest column, the leftmost of equal ones; days of many titles and heights."""
    rnd = random.Random(5)
    rows = [(i, f"Film {rnd.randrange(9)}", f"{rnd.randrange(9, 24):02d}:{rnd.randrange(60):02d}") for i in range(40)]
    packed = balance_columns(film_groups(agenda(spark, rows)))
    cards = packed.collect()
    totals = {r.k: r.total_rows for r in total_rows(packed, ["k"]).collect()}
    for k in (1, 2, 3):
        ends = [0] * k
        for r in sorted((r for r in cards if r.k == k), key=lambda r: (r.earliest_key, r.film_key)):
            low = min(range(k), key=lambda c: (ends[c], c))
            assert (r.col, r.row) == (low, ends[low])
            ends[low] += r.height + 1  # a row stays free behind each card
        assert totals[k] == max(ends) - 1


def laid(day, k):
    cols, rows, _ = place(day, [0] * k)
    return list(zip(cols, rows, strict=True))


#: Heights of a long day: all alike, which never forgets its beginning; mixed; and with cards far higher than the others.
LONG_DAYS = {
    "alike": [2] * 391, "mixed": [random.Random(1).choice([2, 2, 3, 5, 9]) for _ in range(400)],
    "towers": [900 if i in (30, 31, 150) else 2 + i % 3 for i in range(400)], "one tower": [10**6] + [3] * 399, "short": [2, 4, 2, 7],
}


@pytest.mark.parametrize(("chunk", "most"), [(37, 4096), (40, 60)])
def test_a_large_day_is_packed_as_if_in_one_go(spark, chunk, most):
    """Long days are cut in ten chunks and more; the result is that of the plain loop."""
    cards = [(None if day == "mixed" else day, i, h) for day, heights in LONG_DAYS.items() for i, h in enumerate(heights)]
    films = spark.createDataFrame(cards, "day string, film_key long, height long")
    films = films.withColumn("slot", F.floor(F.col("film_key") / 90))
    got = pack(films, [1, 2, 3], ["day"], ["slot"], "film_key", chunk=chunk, most=most)
    by_key = {(r.day or "mixed", r.k, r.film_key): (r.col, r.row) for r in got.collect()}
    assert len(by_key) == 3 * len(cards)
    for day, heights in LONG_DAYS.items():
        for k in (1, 2, 3):
            assert [by_key[day, k, i] for i in range(len(heights))] == laid(heights, k)


def test_ordinary_days_are_folded_once(spark, monkeypatch):
    """Ten chunks, no beginning outside the tables: each card is folded in its table and in its place, no more."""
    asked = []
    composed = packing._composed
    monkeypatch.setattr(packing, "_composed", lambda *a: asked.append(1) or composed(*a))
    heights = LONG_DAYS["alike"][:200] + LONG_DAYS["mixed"][:170]
    films = spark.createDataFrame([("d", i, h) for i, h in enumerate(heights)], "day string, film_key long, height long").withColumn("slot", F.lit(0))
    got = sorted((r.film_key, r.col, r.row) for r in pack(films, [3], ["day"], ["slot"], "film_key", chunk=37).collect())
    assert [r[1:] for r in got] == laid(heights, 3) and asked == [1]


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_chunks_as_functions(k):
    rnd = random.Random(k)
    heights = [rnd.choice([1, 2, 2, 6]) for _ in range(50)]
    table, numbers = packing.transition(heights, k, 300), packing.beginnings(k, 300)[1]
    assert len(numbers) <= 300
    for _ in range(200):
        start = [rnd.choice([0, 1, 3, 7, 500, 10**7]) + 40 for _ in range(k)]
        start[rnd.randrange(k)] = 40
        end = packing.follow(start, sum(heights) + len(heights), numbers, table)
        assert end is None or end == place(heights, start)[2]
    assert packing.follow([0] * k, 10**6, numbers, table) == place(heights, [0] * k)[2]
