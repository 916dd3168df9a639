import datetime as dt

from pyspark.sql import functions as F

from duskboard.functions import dates as D



def days(*ds):
    return [dt.date(2026, m, d) for m, d in ds]


def span(evaluate, cases):
    return [tuple(r) for r in evaluate(lambda c: D.phrase_span(D.date_phrase(c)), list(cases))]


def test_catalan_phrases(evaluate):
    cases = {
        "24 de setembre": days((9, 24)),
        "8 d'agost": days((8, 8)),
        "Del 6 al 9 d'agost": days((8, 6), (8, 7), (8, 8), (8, 9)),
        "Del 6 al 8 i 20 i 22 d'agost": days((8, 6), (8, 7), (8, 8), (8, 20), (8, 22)),
        "4 i 6 d'agost": days((8, 4), (8, 6)),
        "30 de setembre i 1 d'octubre": days((9, 30), (10, 1)),
        "2 de febrer": [dt.date(2027, 2, 2)],
        "31 de setembre": [],
        "": [],
        "7 de fantasia": [],
    }
    cases |= {
        "del 28 al 3 de juliol": [],
        "Del 29 al 31 de juny i 2 de juliol": days((6, 29), (6, 30), (7, 2)),
        "del 30 de juny al 2 de juliol": days((6, 30), (7, 1), (7, 2)),
        "de l'1 al 3 de juliol": days((7, 1), (7, 2), (7, 3)),
        "dissabte 13 de juny a les 20 h": days((6, 13)),
        "de 11h a 13h, 5 de juliol": days((7, 5)),
        "31 de desembre al 1 de gener": [dt.date(2026, 12, 31), dt.date(2027, 1, 1)],
    }
    assert evaluate(lambda c: D.phrase_days(D.date_phrase(c, F.lit(dt.date(2026, 6, 1)))), list(cases)) == list(cases.values())


def test_worded_spans(evaluate):
    d = dt.date
    cases = {
        "Del 3 al 8 de maig de 2026": (d(2026, 5, 3), d(2026, 5, 8)),
        "fins al 9 de maig de 2026": (d(2026, 5, 9), None),
        "del 25 de març al 2 de maig de 2027": (d(2027, 3, 25), d(2027, 5, 2)),
        "10 y 13 de mayo de 2026": (d(2026, 5, 10), d(2026, 5, 13)),
        "Del 28 de noviembre al 3 de febrero de 2027": (d(2026, 11, 28), d(2027, 2, 3)),
        "el 5 d'abril de 2026": (d(2026, 4, 5), None),
        "sense data": (None, None),
    }
    cases |= {
        "From 5 January to 7 March 2027": (d(2027, 1, 5), d(2027, 3, 7)),
        "de l'1 de juliol de 2026 al 2 d'agost de 2026 a les 20.30 h": (d(2026, 7, 1), d(2026, 8, 2)),
        "12 de febrero de 2026 a 14 de marzo": (d(2026, 2, 12), d(2026, 3, 14)),
    }
    assert span(evaluate, cases) == list(cases.values())


def test_numeric_spans(evaluate):
    d = dt.date
    cases = {
        "16/11/25": (d(2025, 11, 16), None),
        "05/12 — 10/01/26": (d(2025, 12, 5), d(2026, 1, 10)),
        "21 i 22/11/25": (d(2025, 11, 21), d(2025, 11, 22)),
        "01/02/2026 al 03/02/2026": (d(2026, 2, 1), d(2026, 2, 3)),
        "05/12": (None, None),
    }
    cases |= {
        "03/06 — 05/07/24": (d(2024, 6, 3), d(2024, 7, 5)),
        "05, 08, 09, 14 i 16/11/25": (d(2025, 11, 5), d(2025, 11, 16)),
        "Del 12.06.2026 al 13.06.2026, 20:30 h": (d(2026, 6, 12), d(2026, 6, 13)),
    }
    assert span(evaluate, cases) == list(cases.values())


def test_month_after_or_before_its_days(evaluate):
    cases = {
        "25, 26, 30 June and 1, 2 July": days((6, 25), (6, 26), (6, 30), (7, 1), (7, 2)),
        "From 5 to 8 July (English)": days((7, 5), (7, 6), (7, 7), (7, 8)),
        "09/07": days((7, 9)),
        "July 9": days((7, 9)),
        "soon": [],
    }
    assert evaluate(lambda c: D.phrase_days(D.date_phrase(c, F.lit(dt.date(2026, 1, 1)))), list(cases)) == list(cases.values())


def test_any_date_form(evaluate):
    cases = {"12/06/2026": dt.date(2026, 6, 12), "12/06/26": dt.date(2026, 6, 12), "04.06.2026": dt.date(2026, 6, 4),
             "2026-06-12T20:00": dt.date(2026, 6, 12), "x 20260612 y": dt.date(2026, 6, 12), "Fri,  5 Jun 2026 18:00": dt.date(2026, 6, 5),
             "31/02/2026": None, "": None, "12": None}
    assert evaluate(D.parse_date_any, list(cases)) == list(cases.values())


def test_times(evaluate):
    cases = {"20:30h": "20:30", "20.30 h": "20:30", "20 h": "20:00", "a les 19h": "19:00", "d'11:00h a 12:30": "11:00", "25:00": None,
             "9:05": "09:05", "res": None}
    assert evaluate(D.parse_time_any, list(cases)) == list(cases.values())
    assert evaluate(D.all_times, ["19:00h / 21:00h", "24:10", ""]) == [["19:00", "21:00"], [], []]


def test_zone_changes_are_exact(evaluate):
    link = "dates=20260329T{}00Z/x"
    got = [tuple(r) for r in evaluate(D.utc_link_to_local, [link.format("0030"), link.format("0130"), "dates=20261025T003000Z", "dates=20261025T013000Z", "none"])]
    assert got == [(dt.date(2026, 3, 29), "01:30"), (dt.date(2026, 3, 29), "03:30"), (dt.date(2026, 10, 25), "02:30"),
                   (dt.date(2026, 10, 25), "02:30"), (None, None)]
    (r,) = evaluate(D.epoch_to_local, [1780340400], "v long")
    assert tuple(r) == (dt.date(2026, 6, 1), "21:00")


def test_session_zone_does_not_matter(spark, evaluate):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Lima")
        (r,) = evaluate(D.epoch_to_local, [1780340400], "v long")
        assert tuple(r) == (dt.date(2026, 6, 1), "21:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_year_policies(evaluate):
    today = F.lit(dt.date(2026, 6, 15))
    day = F.lit(10)
    assert evaluate(lambda m: D.recent_or_next(day, m, today), [1, 5, 8], "v int") == [dt.date(2027, 1, 10), dt.date(2026, 5, 10), dt.date(2026, 8, 10)]
    assert evaluate(lambda m: D.near_publication(day, m, today), [6, 4], "v int") == [dt.date(2026, 6, 10), dt.date(2027, 4, 10)]
    # 10 July is a Friday in 2026 and a Saturday in 2027.
    assert evaluate(lambda w: D.weekday_year(day, F.lit(7), w, today), [4, 5], "v int") == [2026, 2027]
    assert evaluate(lambda m: D.year_before_end(day, m, today), [5, 12], "v int") == [dt.date(2026, 5, 10), dt.date(2025, 12, 10)]


def test_logical_day_and_key(evaluate):
    assert evaluate(lambda t: D.logical_date(F.lit(dt.date(2026, 6, 2)), t), ["04:59", "05:00", None]) == [
        dt.date(2026, 6, 1), dt.date(2026, 6, 2), dt.date(2026, 6, 2)]
    assert evaluate(D.time_sort_key, ["04:59", "05:00", None]) == ["204:59", "105:00", "0"]


def test_headings(evaluate):
    sunday = dt.date(2026, 6, 7)
    assert evaluate(lambda loc: D.day_heading(F.lit(sunday), loc), ["ca", "es", "en"]) == [
        "diumenge, 7 de juny", "domingo, 7 de junio", "Sunday 7 June"]


def test_clock_in_mixed_text(evaluate):
    cases = {"13.06.2026 20:30h": "20:30", "Preu 12.50 € 20:30h": "20:30", "24 hores 20:30": "20:30", "12 hivern 21:00": "21:00", "19.45 h": "19:45",
             "a les 18h": "18:00", "11 h i 22:15": "22:15", "26:00": None, "12.50": None}
    assert evaluate(D.parse_time_any, list(cases)) == list(cases.values())
