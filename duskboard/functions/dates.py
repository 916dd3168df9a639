"""Dates and times as printed on venue pages: Catalan, Spanish and English."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskboard.functions.text import _col, let

# Month names per language, January first.
MONTH_NAMES = {
    "ca": ["gener", "febrer", "març", "abril", "maig", "juny", "juliol", "agost",
           "setembre", "octubre", "novembre", "desembre"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
           "septiembre", "octubre", "noviembre", "diciembre"],
    "en": ["january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december"],
}

_ALL_MONTHS = sorted({n for names in MONTH_NAMES.values() for n in names}, key=lambda n: (-len(n), n))
MONTH_PATTERN = "|".join(_ALL_MONTHS)


def _month_lookup() -> dict[str, int]:
    """Full names and their three-letter short forms, without accents."""
    lookup: dict[str, int] = {}
    for names in MONTH_NAMES.values():
        for number, name in enumerate(names, start=1):
            plain = name.replace("ç", "c")
            lookup[plain] = number
            lookup[plain[:3]] = number
    return lookup


MONTHS = _month_lookup()


def month_number(c: Column | str, prefix: bool = False) -> Column:
    """Month 1-12 of a full or three-letter name in any of the languages, accents optional.

    ``prefix`` also takes longer words by their first three letters.
    """
    return let(plain_letters(F.lower(F.trim(_col(c)))), lambda name: _month_named(name, prefix))


def plain_letters(text: Column) -> Column:
    return F.translate(text, "çéèàóòíìúù", "ceeaooiiuu")


def _month_named(name: Column, prefix: bool) -> Column:
    def find(text: Column) -> Column:
        """A set of all names keeps out what is none; a map of literals would be searched from its start each time."""
        number = F.lit(None).cast("int")
        for month in range(12, 0, -1):
            number = F.when(text.isin(*(n for n, m in MONTHS.items() if m == month)), month).otherwise(number)
        return F.when(text.isin(*MONTHS), number)

    return F.coalesce(find(name), find(F.substring(name, 1, 3))) if prefix else find(name)


def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date, or null for an impossible one."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(
        year.cast("int"), month.cast("int"), day.cast("int"), zero, zero, zero.cast("decimal(16,6)")
    ).cast("date")


def hhmm(hour: Column, minute: Column) -> Column:
    """``HH:mm``, or null outside the clock."""
    ok = hour.between(0, 23) & minute.between(0, 59)
    return F.when(
        ok,
        F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")),
    )


def whole(digits: Column) -> Column:
    """Integer of a run of digits, else null. Cheaper than ``try_cast``, which fails by exception."""
    return F.when(digits.rlike("^[0-9]{1,9}$"), digits).cast("int")


def _int(text: Column, pattern: str, group: int) -> Column:
    return whole(F.regexp_extract(text, pattern, group))


def _full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


NUMERIC_DATE = r"([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4}|[0-9]{2})"
ISO_DATE = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
COMPACT_DATE = r"(?:^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:[^0-9]|$)"
WORDED_DATE = rf"([0-9]{{1,2}})\s+(?:de\s+|d['’]\s*)?([\p{{L}}]+)\.?\s+(?:de\s+)?([0-9]{{4}})"


def _numeric_date(token: Column) -> Column:
    """Date of one ``dd/mm/yyyy`` like token; null for an empty one."""
    parts = F.translate(token, ".", "/")
    year = whole(F.substring_index(parts, "/", -1))
    month = whole(F.substring_index(F.substring_index(parts, "/", 2), "/", -1))
    return ymd(_full_year(year), month, whole(F.substring_index(parts, "/", 1)))


def parse_date_any(c: Column | str) -> Column:
    """First date of a text in any of the numeric, ISO, compact or worded forms; null when invalid.

    A form is looked for only when those before it gave nothing, and its parts are read from the
    matched token, not from the whole text again.
    """

    def worded(token: Column) -> Column:
        return ymd(
            whole(F.substring(token, -4, 4)),
            month_number(F.regexp_extract(token, WORDED_DATE, 2)),
            _int(token, "^([0-9]+)", 1),
        )

    def compact(token: Column) -> Column:
        digits = F.regexp_replace(token, "[^0-9]", "")
        return ymd(*[whole(F.substring(digits, at, n)) for at, n in ((1, 4), (5, 2), (7, 2))])

    def read(text: Column) -> Column:
        return F.coalesce(
            F.regexp_extract(text, ISO_DATE, 0).try_cast("date"),
            let(F.regexp_extract(text, NUMERIC_DATE, 0), _numeric_date),
            let(F.regexp_extract(text, WORDED_DATE, 0), worded),
            let(F.regexp_extract(text, COMPACT_DATE, 0), compact),
        )

    return let(F.lower(_col(c)), read)


def numeric_dates(c: Column | str) -> Column:
    """``array<date>`` of every dd/mm/yyyy, dd/mm/yy or dd.mm.yyyy token; impossible ones are dropped."""
    tokens = F.regexp_extract_all(_col(c), F.lit(NUMERIC_DATE), F.lit(0))
    return F.array_compact(F.transform(tokens, _numeric_date))


def date_span(dates: Column | str, ordered: bool = False) -> Column:
    """``struct<start_date,end_date>`` of a row's dates; the end is null for a single day.

    ``ordered`` keeps the printed order (first and last) instead of earliest and latest.
    """
    arr = _col(dates)
    lo = F.try_element_at(arr, F.lit(1)) if ordered else F.array_min(arr)
    hi = F.try_element_at(arr, F.lit(-1)) if ordered else F.array_max(arr)
    return F.struct(lo.alias("start_date"), F.nullif(hi, lo).alias("end_date"))


# -- year inference -----------------------------------------------------------------------------


def next_month_year(month: Column, today: Column) -> Column:
    """This year, or the next one when the month is already over."""
    return F.year(today) + F.when(month < F.month(today), 1).otherwise(0)


def recent_or_next(day: Column, month: Column, today: Column, days: int = 90) -> Column:
    """This year's date unless it is more than ``days`` past, then next year's."""
    this = ymd(F.year(today), month, day)
    following = ymd(F.year(today) + 1, month, day)
    return F.when(F.datediff(today, this) > days, following).otherwise(this)


def near_publication(day: Column, month: Column, published: Column, slack: int = 30) -> Column:
    """First of the publication year, the next and the previous that is not over ``slack`` days before it."""
    candidates = F.array(*[ymd(F.year(published) + n, month, day) for n in (0, 1, -1)])
    kept = F.filter(candidates, lambda d: d >= F.date_sub(published, slack))
    return F.try_element_at(kept, F.lit(1))


def weekday_year(day: Column, month: Column, weekday: Column, today: Column) -> Column:
    """The year, among three, in which the date falls on the printed weekday and is not past."""
    candidates = F.array(*[ymd(F.year(today) + n, month, day) for n in (0, 1, 2)])
    kept = F.filter(candidates, lambda d: (d >= today) & (F.weekday(d) == weekday))
    fallback = F.year(today) + F.when(ymd(F.year(today), month, day) >= today, 0).otherwise(1)
    return F.coalesce(F.year(F.try_element_at(kept, F.lit(1))), fallback)


def year_before_end(day: Column, month: Column, end: Column) -> Column:
    """Start of a range whose year is printed at its end: the end's year, or the one before."""
    same = ymd(F.year(end), month, day)
    return F.when(same > end, ymd(F.year(end) - 1, month, day)).otherwise(same)


# -- date phrases -------------------------------------------------------------------------------

#: Tokens of a phrase: full numeric dates, times, days with a month, numbers, words, dashes. A time is matched as such
#: so that its numbers are no days.
PHRASE_TOKEN = (
    r"[0-9]{1,2}[/.][0-9]{1,2}[/.](?:[0-9]{4}|[0-9]{2})(?![0-9])|[0-9]{1,2}[:.][0-9]{2}(?:\s*h\b)?|[0-9]{1,2}\s*h(?:\b|ores|oras|rs)"
    r"|[0-9]{1,2}/[0-9]{1,2}|[0-9]+|\p{L}+|[–—-]"
)
#: Words that join a range's start to its end, and words that may stand between those and a date.
RANGE_WORDS = ("al", "a", "to", "fins", "hasta", "until", "till", "-", "–", "—")
ARTICLES = ("de", "d", "del", "el", "l", "la", "dia", "of", "the")

_SPANS = "array<struct<start_date: date, end_date: date>>"
_READ = f"struct<month: int, year: int, behind: date, own: int, near: boolean, open: boolean, spans: {_SPANS}, loose: array<int>, led: {_SPANS}>"


def _token(word: Column, before: Column) -> Column:
    """Class and values of a token in plain letters: full date, time, day and month, day, year, month, range word, article
    or other word. What is used twice is computed once, as no lambda shares its parts."""

    def number(kind: Column) -> Column:
        def fields(parts: Column) -> Column:
            part = lambda i: whole(F.try_element_at(parts, F.lit(i)))
            year = F.when(kind == "full", _full_year(part(3))).when(kind == "year", part(1))
            return F.struct(kind.alias("kind"), F.when(kind != "year", part(1)).alias("day"), part(2).alias("month"), year.alias("year"))

        return let(F.split(word, "[/.]"), fields)

    def name(month: Column) -> Column:
        kind = F.when(month.isNotNull(), "month").when(word.isin(*RANGE_WORDS), "range").when(word.isin(*ARTICLES), "article").otherwise("other")
        none = F.lit(None).cast("int")
        return F.struct(kind.alias("kind"), none.alias("day"), month.alias("month"), none.alias("year"))

    size = F.char_length(word)
    numeric = (
        F.when(F.contains(word, F.lit(":")) | F.contains(word, F.lit("h")), "time").when((size > 5) & word.rlike("[/.].*[/.]"), "full")
        .when(F.contains(word, F.lit("/")), "partial").when(F.contains(word, F.lit(".")), "time")
        .when(size <= 2, "day").when(size == 4, "year").otherwise("other")
    )
    month = F.when(size > 2, F.when(before.isin("de", "d"), _month_named(word, True)).otherwise(_month_named(word, False)))
    return F.when(F.substring(word, 1, 1).between("0", "9"), let(numeric, number)).otherwise(let(month, name))


def date_phrase(c: Column | str, today: Column | None = None) -> Column:
    """``struct<spans: array<struct<start_date,end_date>>, dated>`` of a phrase in Catalan, Spanish or English, in any form
    that venues print; ``dated`` says whether it prints a year.

    The tokens are read once, from the end: a month or year holds for all days before it up to the next one, a range word
    before a day opens the range to it. A year that is not printed behind a day is the last printed one, else the month's
    next from ``today`` on; without ``today`` such days are dropped, as are days that do not exist. A range of one month
    that runs backwards gives nothing; one of two months runs over New Year. Days that only stand behind a month
    ("July 9") count when no others are found. Brackets are left out. Spans are sorted; a single day ends as it starts.
    """
    text = plain_letters(F.lower(F.regexp_replace(_col(c), r"\([^)]*\)", " ")))
    nothing = F.struct(
        F.lit(None).alias("month"), F.lit(None).alias("year"), F.lit(None).alias("behind"), F.lit(None).alias("own"),
        F.lit(False).alias("near"), F.lit(False).alias("open"), F.array().alias("spans"), F.array().alias("loose"), F.array().alias("led"),
    ).cast(_READ)

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start_date"), end.alias("end_date"))

    def step(printed: Column) -> Callable[[Column, Column], Column]:
        def year_of(month: Column, year: Column) -> Column:
            guess = F.lit(None).cast("int") if today is None else next_month_year(month, today)
            return F.coalesce(year, printed, guess)

        def dated(acc: Column, token: Column) -> Column:
            """A token with a day: alone, or the start of the range to the date read before it."""

            def placed(at: Column) -> Column:
                """``at`` is the day's month, year as far as it is printed, and date."""
                date, behind = at["date"], acc["behind"]

                def ranged(last: Column) -> Column:
                    alone = F.coalesce((last["start_date"] == behind) & (last["end_date"] == behind), F.lit(False))
                    others = F.when(alone, F.slice(acc["spans"], F.lit(1), F.size(acc["spans"]) - 1)).otherwise(acc["spans"])
                    past = F.when(at["printed"].isNotNull(), span(F.add_months(date, -12), behind)).otherwise(span(date, F.add_months(behind, 12)))
                    return (
                        F.when(date <= behind, F.concat(others, F.array(span(date, behind))))
                        .when(at["month"] != acc["own"], F.concat(others, F.array(past))).otherwise(others)
                    )

                opened = acc["open"] & behind.isNotNull()
                spans = (
                    F.when(date.isNull(), acc["spans"]).when(opened, let(F.try_element_at(acc["spans"], F.lit(-1)), ranged))
                    .otherwise(F.concat(acc["spans"], F.array(span(date, date))))
                )
                # A range to a day that its month lacks runs to the month's end.
                month_end = F.when(token["day"].between(29, 31), F.last_day(ymd(at["year"], at["month"], F.lit(1))))
                loose = F.when(at["month"].isNull(), F.concat(acc["loose"], F.array(token["day"]))).otherwise(acc["loose"])
                return F.struct(  # types as in _READ: a cast would copy the arrays
                    at["month"].alias("month"), F.coalesce(token["year"], acc["year"]).alias("year"), F.coalesce(date, month_end).alias("behind"),
                    at["month"].alias("own"), F.lit(True).alias("near"), F.lit(False).alias("open"), spans.alias("spans"), loose.alias("loose"), acc["led"].alias("led"),
                )

            def known(at: Column) -> Column:
                return F.struct(at["month"].alias("month"), at["printed"].alias("printed"), at["year"].alias("year"), ymd(at["year"], at["month"], token["day"]).alias("date"))

            month = F.coalesce(token["month"], acc["month"])
            year = F.coalesce(token["year"], acc["year"])
            at = F.struct(month.alias("month"), F.coalesce(year, printed).alias("printed"), year_of(month, year).alias("year"))
            return let(let(at, known), placed)

        def one(acc: Column, token: Column) -> Column:
            kind = token["kind"]
            led = F.transform(acc["loose"], lambda d: ymd(year_of(token["month"], acc["year"]), token["month"], d))
            led = F.transform(F.array_compact(led), lambda d: span(d, d))

            def kept(**new: Column) -> Column:
                fields = ("month", "year", "behind", "own", "near", "open", "spans", "loose", "led")
                return F.struct(*(new.get(f, acc[f]).alias(f) for f in fields))

            return (
                F.when(kind.isin("full", "partial", "day"), dated(acc, token))
                .when(kind == "month", kept(month=token["month"], near=F.lit(True), loose=F.array().cast("array<int>"), led=F.concat(acc["led"], led)))
                .when(kind == "year", kept(year=token["year"], near=F.lit(True)))
                .when(kind == "range", kept(open=acc["open"] | acc["near"]))
                .otherwise(kept(near=F.lit(False)))
            )

        return one

    def read(tokens: Column) -> Column:
        def fold(printed: Column) -> Column:
            def result(found: Column) -> Column:
                spans = F.when(F.size(found["spans"]) > 0, found["spans"]).otherwise(found["led"])
                return F.struct(F.array_sort(F.array_distinct(spans)).alias("spans"), printed.isNotNull().alias("dated"))

            return let(F.aggregate(F.reverse(tokens), nothing, step(printed)), result)

        return let(F.try_element_at(F.filter(tokens, lambda t: t["year"].isNotNull()), F.lit(-1))["year"], fold)

    def classed(words: Column) -> Column:
        before = F.concat(F.array(F.lit("")), words)
        return F.zip_with(words, F.slice(before, F.lit(1), F.size(words)), _token)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE_TOKEN), F.lit(0))
    return let(F.filter(let(words, classed), lambda t: t["kind"] != "article"), read)


def phrase_days(phrase: Column) -> Column:
    """``array<date>`` of every day of a :func:`date_phrase`, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(phrase["spans"], lambda s: F.sequence(s["start_date"], s["end_date"])))))


def phrase_span(phrase: Column) -> Column:
    """``struct<start_date,end_date>`` from the first to the last day of a :func:`date_phrase`; no end for a single day."""
    first = F.array_min(F.transform(phrase["spans"], lambda s: s["start_date"]))
    last = F.array_max(F.transform(phrase["spans"], lambda s: s["end_date"]))
    return F.struct(first.alias("start_date"), F.nullif(last, first).alias("end_date"))


# -- times --------------------------------------------------------------------------------------

# A dot is a clock's only with an h behind it; that h ends a word.
CLOCK = r"(?:^|[^0-9.:])(?:([0-9]{1,2}):([0-9]{2})|([0-9]{1,2})\.([0-9]{2})\s*h(?![\p{L}0-9]))"
BARE_HOUR = r"(?:^|[^0-9.:])([0-9]{1,2})\s*h(?![\p{L}0-9])"


def parse_time_any(c: Column | str) -> Column:
    """First clock time of a text as ``HH:mm``, else its first hour alone; null when there is none or it is off the clock."""
    text = F.lower(_col(c))
    hour = F.coalesce(_int(text, CLOCK, 1), _int(text, CLOCK, 3), _int(text, BARE_HOUR, 1))
    return hhmm(hour, F.coalesce(_int(text, CLOCK, 2), _int(text, CLOCK, 4), F.lit(0)))


def all_times(c: Column | str) -> Column:
    """``array<string>`` of every HH:MM in a schedule text, in printed order."""
    found = F.regexp_extract_all(_col(c), F.lit("([0-9]{1,2}:[0-9]{2})"), F.lit(1))
    times = F.transform(
        found,
        lambda t: hhmm(F.substring_index(t, ":", 1).cast("int"), F.substring_index(t, ":", -1).cast("int")),
    )
    return F.array_compact(times)


def _wall(ts: Column) -> Column:
    return F.struct(
        ts.cast("date").alias("date"), F.date_format(ts, "HH:mm").alias("time")
    )


def epoch_to_local(c: Column | str, tz: str = "Europe/Madrid", offset_hours: int = 0) -> Column:
    """``struct<date,time>`` on the venue's wall clock; independent of the session's time zone.

    ``offset_hours`` corrects a feed whose clock is off by a constant.
    """
    seconds = _col(c).cast("bigint") + offset_hours * 3600
    start = F.lit(dt.date(1970, 1, 1)).cast("timestamp_ntz")
    utc = start + F.make_dt_interval(
        F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400))
    )
    return _wall(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc))


def iso_wall_clock(c: Column | str) -> Column:
    """``struct<date,time>`` as written: the offset is dropped, nothing is shifted."""
    pattern = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[T ]([0-9]{2}):([0-9]{2}))?"
    text = _col(c)
    return F.struct(
        ymd(*[_int(text, pattern, g) for g in (1, 2, 3)]).alias("date"),
        hhmm(_int(text, pattern, 4), _int(text, pattern, 5)).alias("time"),
    )


def utc_link_to_local(c: Column | str, tz: str = "Europe/Madrid") -> Column:
    """``struct<date,time>`` of a calendar link's ``dates=YYYYMMDDTHHMMSS`` UTC stamp.

    The named zone decides between winter and summer time, to the day.
    """
    pattern = r"dates=([0-9]{4})([0-9]{2})([0-9]{2})T([0-9]{2})([0-9]{2})([0-9]{2})"
    parts = [F.regexp_extract(_col(c), pattern, g) for g in range(1, 7)]
    stamp = F.concat(
        parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(" "),
        parts[3], F.lit(":"), parts[4], F.lit(":"), parts[5],
    ).try_cast("timestamp_ntz")
    return _wall(F.convert_timezone(F.lit("UTC"), F.lit(tz), stamp))


def all_day_sentinels(
    start_time: Column | str,
    end_time: Column | str,
    uncertain: Column | None = None,
    exhibition: Column | None = None,
) -> Column:
    """``struct<start_time,end_time>`` with the stand-ins for "time unknown" turned into nulls."""
    start, end = _col(start_time), _col(end_time)
    none = F.lit(None).cast("string")
    false = F.lit(False)
    show = F.coalesce(exhibition, false) if exhibition is not None else false
    unsure = F.coalesce(uncertain, false) if uncertain is not None else false
    midnight = F.coalesce(start == "00:00", false)
    all_day = midnight & F.coalesce(end.isin("23:59", "23:59:59"), false)
    return F.struct(
        F.when(midnight | unsure | show, none).otherwise(start).alias("start_time"),
        F.when(all_day | show | F.coalesce(end == start, false), none).otherwise(end).alias("end_time"),
    )


# -- the agenda's clock -------------------------------------------------------------------------


def logical_date(date: Column | str, time: Column | str) -> Column:
    """Day an event is listed under: before 05:00 it belongs to the evening before."""
    return F.when(_col(time) < "05:00", F.date_sub(_col(date), 1)).otherwise(_col(date))


def time_sort_key(time: Column | str) -> Column:
    """Order within a day: no time, then from 05:00 on, then the small hours."""
    t = _col(time)
    return (
        F.when(t.isNull(), F.lit("0"))
        .when(t >= "05:00", F.concat(F.lit("1"), t))
        .otherwise(F.concat(F.lit("2"), t))
    )


def earliest_session(start_times: Column | str, start_time: Column | str) -> Column:
    """Earliest listed session, else the scalar time."""
    return F.coalesce(F.array_min(_col(start_times)), _col(start_time))


# Weekday names Monday first, short month names for headings.
WEEKDAYS = {
    "ca": ["dilluns", "dimarts", "dimecres", "dijous", "divendres", "dissabte", "diumenge"],
    "es": ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"],
    "en": ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"],
}
HEADING_MONTHS = {
    "ca": ["de gener", "de febrer", "de març", "d’abril", "de maig", "de juny", "de juliol", "d’agost",
           "de setembre", "d’octubre", "de novembre", "de desembre"],
    "es": ["de " + m for m in MONTH_NAMES["es"]],
    "en": [m.capitalize() for m in MONTH_NAMES["en"]],
}


def day_heading(date: Column | str, locale: Column) -> Column:
    """Localized "weekday day month" heading."""
    d = _col(date)
    weekday = F.weekday(d) + 1
    month = F.month(d)

    def pick(table: dict[str, list[str]], index: Column) -> Column:
        per_locale = {k: F.element_at(F.array(*[F.lit(v) for v in vs]), index) for k, vs in table.items()}
        return F.when(locale == "es", per_locale["es"]).when(locale == "en", per_locale["en"]).otherwise(per_locale["ca"])

    day = F.dayofmonth(d).cast("string")
    comma = F.when(locale == "en", F.lit(" ")).otherwise(F.lit(", "))
    return F.concat(pick(WEEKDAYS, weekday), comma, day, F.lit(" "), pick(HEADING_MONTHS, month))
