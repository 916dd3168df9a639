"""Category, label and status columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskboard.functions.text import _col

# Category names per locale.
CATEGORY_NAMES = {
    "ca": {"film": "Cinema", "jazz": "Jazz", "classical": "Clàssica", "theater": "Teatre", "club": "Club",
           "flamenco": "Flamenc", "dance": "Dansa", "kids": "Infantil", "pop": "Pop"},
    "es": {"film": "Cine", "jazz": "Jazz", "classical": "Clásica", "theater": "Teatro", "club": "Club",
           "flamenco": "Flamenco", "dance": "Danza", "kids": "Infantil", "pop": "Pop"},
    "en": {"film": "Film", "jazz": "Jazz", "classical": "Classical", "theater": "Theater", "club": "Club",
           "flamenco": "Flamenco", "dance": "Dance", "kids": "Kids", "pop": "Pop"},
}
# Labels of the two special prices per locale.
PRICE_LABELS = {
    "ca": {"free": "Gratuït", "sold-out": "Exhaurit"},
    "es": {"free": "Gratis", "sold-out": "Agotado"},
    "en": {"free": "Free", "sold-out": "Sold out"},
}
LOCALES = ["ca", "es", "en"]

# Words of a badge.
CANCELLED_WORDS = "cancel"
SOLD_OUT_WORDS = "sold\\s*out|exhaurit|esgotad|esgotat"


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def category_name(slug: Column | str, locale: Column | str) -> Column:
    """Localized category name; an unknown slug names itself."""
    table = {f"{loc}/{k}": v for loc, names in CATEGORY_NAMES.items() for k, v in names.items()}
    return F.coalesce(F.try_element_at(_lookup(table), F.concat(_col(locale), F.lit("/"), _col(slug))), _col(slug))


def display_price(price: Column | str, locale: Column | str) -> Column:
    """Localized label for a special price, any other text as it is, '' when unknown."""
    table = {f"{loc}/{k}": v for loc, names in PRICE_LABELS.items() for k, v in names.items()}
    label = F.try_element_at(_lookup(table), F.concat(_col(locale), F.lit("/"), _col(price)))
    return F.coalesce(label, _col(price), F.lit(""))


def labels(
    *parts: Column | str,
    separator: str = " / ",
    without: Column | None = None,
) -> Column:
    """``array<string>`` of distinct non-empty labels in order; compound ones are split.

    ``without`` drops the label that already decided the category.
    """
    pieces = F.flatten(
        F.transform(F.array_compact(F.array(*[_col(p) for p in parts])), lambda p: F.split(p, separator, -1))
    )
    kept = F.array_distinct(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""))
    if without is None:
        return kept
    return F.filter(kept, lambda p: F.coalesce(F.lower(p) != F.lower(without), F.lit(True)))


def map_categories(tags: Column | str, table: Mapping[str, str], default: str = "theater") -> Column:
    """``struct<category_slugs,annotations>``: mapped labels become categories, the rest annotations."""
    lookup = _lookup({k.lower(): v for k, v in table.items()})
    arr = F.filter(_col(tags), lambda t: t.isNotNull() & (F.trim(t) != ""))
    slugs = F.array_distinct(
        F.array_compact(F.transform(arr, lambda t: F.try_element_at(lookup, F.lower(F.trim(t)))))
    )
    rest = F.filter(arr, lambda t: F.try_element_at(lookup, F.lower(F.trim(t))).isNull())
    return F.struct(
        F.when(F.size(slugs) > 0, slugs).otherwise(F.array(F.lit(default))).alias("category_slugs"),
        rest.alias("annotations"),
    )


def keyword_categories(text: Column | str, rules: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """Category of the first pattern that a text matches, in rule order, else the default."""
    low = F.lower(_col(text))
    chain = None
    for pattern, slug in rules:
        hit = low.rlike(pattern)
        chain = F.when(hit, F.lit(slug)) if chain is None else chain.when(hit, F.lit(slug))
    fallback = F.lit(default) if isinstance(default, str) else default
    return fallback if chain is None else chain.otherwise(fallback)


def added_categories(text: Column | str, rules: Sequence[tuple[str, str]], base: Column | str) -> Column:
    """``array<string>`` of the base category and those of all patterns that a text matches, in rule order."""
    low = F.lower(_col(text))
    first = F.lit(base) if isinstance(base, str) else base
    more = [F.when(F.coalesce(low.rlike(pattern), F.lit(False)), F.lit(slug)) for pattern, slug in rules]
    return F.array_distinct(F.array_compact(F.array(first, *more)))


def any_label(arr: Column | str, triggers: Sequence[str]) -> Column:
    """Whether a row carries any of the trigger labels."""
    return F.coalesce(F.arrays_overlap(_col(arr), F.array(*[F.lit(t) for t in triggers])), F.lit(False))


def first_matching_rule(arr: Column | str, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Slug of the first rule whose trigger labels meet the row's labels."""
    chain = None
    for triggers, slug in rules:
        hit = any_label(arr, triggers)
        chain = F.when(hit, F.lit(slug)) if chain is None else chain.when(hit, F.lit(slug))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def order_categories(arr: Column | str, first: str = "theater") -> Column:
    """Array with one slug in front and the others in alphabetical order."""
    distinct = F.array_distinct(_col(arr))
    return F.concat(
        F.filter(distinct, lambda s: s == first), F.array_sort(F.filter(distinct, lambda s: s != first))
    )


def feed_flag(c: Column | str) -> Column:
    """A feed's flag as a boolean: false where it is missing, blank, a nought, or a word for no."""
    given = F.trim(_col(c).cast("string"))
    return F.when(given.isNull() | given.rlike(r"(?i)^(|0+(\.0+)?|no?|f|false)$"), False).otherwise(True)


def status_override(label: Column | str, price: Column | str) -> Column:
    """``struct<price,cancelled>``: a badge overrules the parsed price."""
    low = F.lower(_col(label))
    sold = F.coalesce(low.rlike(SOLD_OUT_WORDS), F.lit(False))
    return F.struct(
        F.when(sold, F.lit("sold-out")).otherwise(_col(price)).alias("price"),
        F.coalesce(low.rlike(CANCELLED_WORDS), F.lit(False)).alias("cancelled"),
    )


def recurrence_hint(
    title: Column | str, date: Column | str, description: Column | str, weekly_title: str
) -> Column:
    """Printed recurrence: a Monday series by title or description, a weekly jam by name."""
    false = F.lit(False)
    name = F.lower(_col(title))
    monday = F.coalesce((name == weekly_title.lower()) & (F.weekday(_col(date)) == 0), false)
    said = F.coalesce(F.contains(F.lower(_col(description)), F.lit("cada dilluns")), false)
    return F.when(monday | said, F.lit("every Monday")).when(
        F.contains(name, F.lit("jam")), F.lit("weekly")
    )


def translations_array(contents: Mapping[str, tuple[Column, Column, Column]]) -> Column:
    """``array<struct<lang,title,description,source_url>>``; languages without a title are skipped."""
    rows = F.array(
        *[
            F.struct(
                F.lit(lang).alias("lang"),
                F.nullif(F.trim(title), F.lit("")).alias("title"),
                F.nullif(F.trim(description), F.lit("")).alias("description"),
                url.alias("source_url"),
            )
            for lang, (title, description, url) in contents.items()
        ]
    )
    return F.filter(rows, lambda r: r["title"].isNotNull())
