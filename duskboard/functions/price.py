"""Prices: null unknown, ``free``, ``sold-out``, else a display text in euros."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskboard.functions.text import _col, let

# Marker words of each pricing policy, matched on lower-cased text.
FREE = {
    "sold_free_amount": "gratu[ïi]",
    "free_sold_amount": "entrada\\s+gratu[ïi]?ta|activitat\\s+gratu[ïi]?ta|gratu[ïi]?t",
    "amount_sold_free": "accés\\s+lliure|entrada\\s+gratu|activitat\\s+gratu|gratu[ïi]ta?|entrada\\s+libre|free",
    "sold_amount_free": "\\bfree\\b|gratu[ïi]?t|entrada\\s+lliure",
    "bundled_amount_free": "gratu[ïi]?t",
}
SOLD_OUT = {
    "sold_free_amount": "exhaurit|esgotat|sold.?out",
    "free_sold_amount": "\\bsold[- ]?out\\b|esgotat",
    "amount_sold_free": "\\bs\\.?\\s*o\\.?\\b|exhaurit|sold\\s*out|esgotad",
    "sold_amount_free": "sold[- ]?out|esgotat|s\\.o\\.",
}
UNKNOWN = "(a|per)\\s+determinar|tbd"
BUNDLED = "inclòs|preu de l'entrada"

# The order in which each family of sources reads its price text, and how it rounds.
POLICIES = {
    "sold_free_amount": ("floor", ("sold", "free", "amount")),
    "free_sold_amount": ("even", ("free", "sold", "amount")),
    "amount_sold_free": ("floor", ("unknown", "phrase_amount", "sold", "free")),
    "sold_amount_free": ("even", ("sold", "amount", "free")),
    "bundled_amount_free": ("floor", ("bundled", "top_amount", "free")),
}

# Words after which only member or discount prices follow.
TIER_CUT = r"\(|/|socis|abonats|palau jove|aula palau|especial|discapacitat|anticipada|general"


def euros(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit("€"))


def format_eur_range(lo: Column | str, hi: Column | str) -> Column:
    """One price unless the high end is at least twice the low one."""
    lo, hi = _col(lo), _col(hi)
    single = (hi <= 0) | (lo == hi) | (hi < 2 * lo)
    return F.when(single, euros(hi)).when(
        hi.isNotNull(), F.concat(lo.cast("string"), F.lit("–"), euros(hi))
    )


def amounts(c: Column | str, pattern: str) -> Column:
    """``array<double>`` of every amount the pattern's first group names; decimal commas allowed."""
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit(".")).cast("double"))


def euro_amounts(c: Column | str) -> Column:
    """Amounts beside a euro sign or the word, on either side, read from left to right: a sign serves one amount or range."""
    number = r"(?:[0-9]{1,3}(?:\.[0-9]{3})+(?![0-9])|[0-9]+)(?:[.,][0-9]{1,2}(?![0-9]))?"
    beside = rf"{number}\s*(?:€|euros?)|€\s*{number}(?:-{number})?"
    found = F.regexp_extract_all(_col(c), F.lit(beside), F.lit(0))
    numbers = F.flatten(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit(number), F.lit(0))))
    plain = F.transform(numbers, lambda t: F.regexp_replace(t, r"\.(?=[0-9]{3})", ""))
    return F.transform(plain, lambda t: F.replace(t, F.lit(","), F.lit(".")).cast("double"))


def price_bounds(values: Column, rounding: str = "even") -> Column:
    """``struct<lo,hi>`` in whole euros of an array of amounts."""
    whole = (lambda v: F.bround(v, 0)) if rounding == "even" else (lambda v: F.floor(v))
    return F.struct(
        whole(F.array_min(values)).cast("int").alias("lo"),
        whole(F.array_max(values)).cast("int").alias("hi"),
    )


def normalize_price(c: Column | str, policy: str, rounding: str | None = None) -> Column:
    """Free text to the price convention; the policy fixes which reading wins."""
    default_rounding, steps = POLICIES[policy]
    mode = rounding or default_rounding
    text = F.lower(F.nullif(F.trim(_col(c)), F.lit("")))

    def read(r: Column) -> Column:
        t, n, lo, hi = r["t"], r["n"], r["b"]["lo"], r["b"]["hi"]
        shown = F.when((n > 0) & hi.isNull(), F.lit("free"))
        rules = {
            "unknown": (t.rlike(UNKNOWN), F.lit(None).cast("string")),
            "bundled": (t.rlike(BUNDLED), F.lit("free")),
            "sold": (t.rlike(SOLD_OUT.get(policy, "$^")), F.lit("sold-out")),
            "free": (t.rlike(FREE[policy]), F.lit("free")),
            "amount": (n > 0, shown.otherwise(format_eur_range(lo, hi))),
            # A range only where the text says "from .. to ..", else the highest price.
            "phrase_amount": (
                n > 0,
                shown.when(t.rlike(r"\bde\b.*\ba\b"), format_eur_range(lo, hi)).otherwise(euros(hi)),
            ),
            "top_amount": (n > 0, shown.otherwise(euros(hi))),
        }
        chain = F.when(t.isNull(), F.lit(None).cast("string"))
        return reduce(lambda acc, step: acc.when(*rules[step]), steps, chain).otherwise(F.lit(None).cast("string"))

    def bounds(found: Column) -> Column:
        public = F.filter(found, lambda v: v > 0)
        return F.struct(text.alias("t"), F.size(found).alias("n"), price_bounds(public, mode).alias("b"))

    return let(let(euro_amounts(text), bounds), read)


def cut_price_tiers(c: Column | str, ceiling: int = 500) -> Column:
    """``array<int>`` of public prices: the member tail is cut, zero and absurd values are ignored."""
    main = F.element_at(F.split(F.lower(_col(c)), TIER_CUT, 2), 1)
    found = F.transform(
        F.regexp_extract_all(main, F.lit(r"([0-9]+)(?:[.,][0-9]+)?"), F.lit(1)),
        lambda t: t.try_cast("int"),
    )
    return F.filter(found, lambda v: (v > 0) & (v <= ceiling))


def structured_price(
    price: Column | str,
    availability: Column | str,
    min_price: Column | str | None = None,
    max_price: Column | str | None = None,
    cents: bool = False,
) -> Column:
    """Price from a number, an availability URL and an optional min/max specification: in whole euros, or with ``cents`` the
    number as it stands, without zeros at its end."""
    value = _col(price).try_cast("double")
    if cents:
        top = F.bround(value * 100, 0).cast("long")
        rest = F.regexp_replace(F.lpad((top % 100).cast("string"), 2, "0"), "0+$", "")
        shown = F.concat(F.floor(top / 100).cast("string"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("€"))
        return (
            F.when(F.endswith(_col(availability), F.lit("SoldOut")), F.lit("sold-out"))
            .when(top.isNull(), F.lit(None).cast("string")).when(top == 0, F.lit("free")).otherwise(shown)
        )
    low = value if min_price is None else F.coalesce(_col(min_price).try_cast("double"), value)
    high = value if max_price is None else F.coalesce(_col(max_price).try_cast("double"), value)
    lo, hi = F.bround(low, 0).cast("int"), F.bround(high, 0).cast("int")
    return (
        F.when(F.endswith(_col(availability), F.lit("SoldOut")), F.lit("sold-out"))
        .when(value.isNull(), F.lit(None).cast("string"))
        .when(value == 0, F.lit("free"))
        .otherwise(format_eur_range(lo, hi))
    )


def cents_price(cents: Column | str) -> Column:
    """Highest of an array of cent texts as ``7,50€`` or ``6€``; unreadable entries are skipped."""
    top = F.array_max(F.transform(_col(cents), lambda t: t.try_cast("int")))
    whole, rest = F.floor(top / 100).cast("int"), top % 100
    return F.when(rest == 0, euros(whole)).when(
        top.isNotNull(),
        F.concat(whole.cast("string"), F.lit(","), F.lpad(rest.cast("string"), 2, "0"), F.lit("€")),
    )
