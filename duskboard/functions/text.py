"""Text and URL columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities venue pages use, with what they stand for.
NAMED_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&agrave;": "à", "&aacute;": "á", "&egrave;": "è", "&eacute;": "é", "&iacute;": "í",
    "&iuml;": "ï", "&ograve;": "ò", "&oacute;": "ó", "&uacute;": "ú", "&uuml;": "ü",
    "&ccedil;": "ç", "&ntilde;": "ñ", "&middot;": "·", "&laquo;": "«", "&raquo;": "»",
    "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“",
    "&rdquo;": "”", "&hellip;": "…", "&euro;": "€", "&copy;": "©", "&reg;": "®",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _codepoint(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric_entities(text: Column) -> Column:
    """``&#233;`` and ``&#xE9;`` to their character; each distinct code is replaced once."""
    decimal = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#([0-9]{1,6});"), F.lit(1)))
    text = F.aggregate(
        decimal,
        text,
        lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _codepoint(n.cast("bigint"))),
    )
    hexadecimal = F.array_distinct(
        F.regexp_extract_all(text, F.lit(r"&#[xX]([0-9a-fA-F]{1,5});"), F.lit(1))
    )
    return F.aggregate(
        hexadecimal,
        text,
        lambda acc, n: F.regexp_replace(
            acc, F.concat(F.lit("&#[xX]"), n, F.lit(";")), _codepoint(F.conv(n, 16, 10).cast("bigint"))
        ),
    )


def decode_entities(c: Column | str) -> Column:
    """HTML entities to characters; ``&amp;`` goes last so that nothing is decoded twice."""
    raw = _col(c)
    text = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), NAMED_ENTITIES.items(), raw)
    text = F.when(F.contains(text, F.lit("&#")), _numeric_entities(text)).otherwise(text)
    return F.when(F.contains(raw, F.lit("&")), F.replace(text, F.lit("&amp;"), F.lit("&"))).otherwise(raw)


def squeeze(c: Column | str) -> Column:
    """Collapse white space (no-break space included) and trim."""
    return F.trim(F.regexp_replace(_col(c), "[\\s ]+", " "))


def clean_text(c: Column | str, line_breaks: bool = False) -> Column:
    """Decoded, squeezed text. ``line_breaks`` also joins words split over lines by a hyphen."""
    text = decode_entities(c)
    if line_breaks:
        text = F.regexp_replace(F.regexp_replace(text, "­ ?", ""), r"-\s+", "")
    return squeeze(text)


def strip_html(c: Column | str) -> Column:
    """Visible text of a fragment or page: no scripts, styles, comments or tags."""
    text = F.regexp_replace(_col(c), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    return squeeze(decode_entities(text))


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Accent folding by rule: the ASCII part of each letter's compatibility decomposition."""
    single_from, single_to, several = [], [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), 0x2026]:
        ch = chr(code)
        ascii_part = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(ascii_part) == 1:
            single_from.append(ch)
            single_to.append(ascii_part)
        elif len(ascii_part) > 1:
            several.append((ch, ascii_part))
    return "".join(single_from), "".join(single_to), several


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_tables()


def fold_accents(c: Column | str) -> Column:
    """ASCII form of a text; what has none is dropped."""
    text = F.translate(_col(c), _FOLD_FROM, _FOLD_TO)
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _FOLD_SEVERAL])
    text = F.when(
        text.rlike(f"[{''.join(a for a, _ in _FOLD_SEVERAL)}]"),
        F.aggregate(table, text, lambda acc, kv: F.replace(acc, kv["a"], kv["b"])),
    ).otherwise(text)
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def slugify(c: Column | str) -> Column:
    """Lower-case ASCII slug of a title without its parenthesised tags."""
    text = F.lower(fold_accents(F.regexp_replace(_col(c), r"\([^)]*\)", "")))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def absolutize_url(c: Column | str, base: Column | str) -> Column:
    """Absolute URL from a protocol-relative, rooted or bare path; the site's own host is forced to https."""
    url = F.trim(_col(c))
    site = F.lit(base) if isinstance(base, str) else base
    plain = F.regexp_replace(site, "^https://", "http://")
    absolute = (
        F.when(url == "", F.lit(None).cast("string"))
        .when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(site, url))
        .when(url.rlike("^https?://"), url)
        .otherwise(F.concat(site, F.lit("/"), url))
    )
    return F.when(
        F.startswith(absolute, plain), F.concat(site, F.substr(absolute, F.length(plain) + 1))
    ).otherwise(absolute)


def normalize_url(c: Column | str) -> Column:
    """URL without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(_col(c), "[?#].*$", ""), "/+$", "")


def url_slug(c: Column | str) -> Column:
    """Last path segment."""
    return F.regexp_extract(normalize_url(c), "([^/]*)$", 1)


def url_param(c: Column | str, name: str) -> Column:
    """Query parameter, null when absent or empty."""
    return F.nullif(F.regexp_extract(_col(c), f"[?&]{name}=([^&#]*)", 1), F.lit(""))


def localized_urls(c: Column | str, prefixes: dict[str, str]) -> Column:
    """``array<struct<lang,url>>`` of the same slug under each language's path prefix."""
    url = normalize_url(c)
    site = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    return F.array(
        *[
            F.struct(
                F.lit(lang).alias("lang"),
                F.concat(site, F.lit(f"/{prefix}/"), url_slug(c)).alias("url"),
            )
            for lang, prefix in prefixes.items()
        ]
    )


def strip_bracket_suffix(c: Column | str) -> Column:
    """Title without one trailing ``(..)`` or ``[..]`` tag."""
    return F.trim(F.regexp_replace(_col(c), r"\s*[(\[][^()\[\]]*[)\]]\s*$", ""))


def film_key(c: Column | str) -> Column:
    """Key under which differently spelled versions of one film meet."""
    return F.lower(strip_bracket_suffix(c))


def capital_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"\p{Lu}"))


def split_packed_title(c: Column | str) -> Column:
    """``HH:MMh | NAME (genre, genre) PRICE`` to ``struct<title,start_time,price,genres>``."""
    raw = _col(c)
    prefix = r"^\s*(\d{1,2}):(\d{2})h\s*\|\s*"
    hh = F.nullif(F.regexp_extract(raw, prefix, 1), F.lit("")).cast("int")
    mm = F.nullif(F.regexp_extract(raw, prefix, 2), F.lit("")).cast("int")
    start = F.when(
        (hh < 24) & (mm < 60),
        F.concat(F.lpad(hh.cast("string"), 2, "0"), F.lit(":"), F.lpad(mm.cast("string"), 2, "0")),
    )
    rest = F.regexp_replace(raw, prefix, "")
    free_words = "(?iu)(entrada\\s+libre|gratis|gratu[ïi]t|lliure)"
    is_free = rest.rlike(free_words)
    amount = F.regexp_extract(rest, r"(\d+\s*€)\s*$", 1)
    price = F.when(is_free, F.lit("free")).when(amount != "", F.replace(amount, F.lit(" "), F.lit("")))
    # Only the first free phrase goes, as a second one belongs to the name.
    unpriced = F.when(is_free, F.regexp_replace(rest, "(?isu)^(.*?)" + free_words, "$1")).otherwise(
        F.regexp_replace(rest, r"(\d+\s*€)\s*$", "")
    )
    last_group = r"(?s)^(.*)\(([^()]*)\)(.*?)$"
    inner = F.regexp_extract(unpriced, last_group, 2)
    genres = F.filter(F.transform(F.split(inner, ","), lambda g: F.trim(g)), lambda g: g != "")
    name = F.regexp_replace(unpriced, last_group, "$1$3")
    title = F.regexp_replace(squeeze(name), r"^[ \-|·–]+|[ \-|·–]+$", "")
    return F.struct(
        title.alias("title"), start.alias("start_time"), price.alias("price"), genres.alias("genres")
    )


def split_series(c: Column | str) -> Column:
    """``title | series`` at the last bar to ``struct<title,series>``; both sides must be filled."""
    text = squeeze(c)
    head = F.trim(F.regexp_extract(text, r"^(.*)\|([^|]*)$", 1))
    tail = F.trim(F.regexp_extract(text, r"^(.*)\|([^|]*)$", 2))
    both = (head != "") & (tail != "")
    return F.struct(
        F.when(both, head).otherwise(text).alias("title"), F.when(both, tail).alias("series")
    )


def split_version_tag(c: Column | str) -> Column:
    """``NAME (VOSE) (EXTRA)`` to ``struct<title,tag>``: text before the first bracket, first VO tag."""
    raw = _col(c)
    title = F.regexp_replace(F.substring_index(raw, "(", 1), "^[ –-]+|[ –-]+$", "")
    tag = F.upper(F.nullif(F.regexp_extract(raw, r"(?i)\((VO[^)]*)\)", 1), F.lit("")))
    return F.struct(F.when(title == "", raw).otherwise(title).alias("title"), tag.alias("tag"))


def truncate_description(c: Column | str, limit: int = 500) -> Column:
    """Text cut at ``limit`` characters with an ellipsis."""
    text = _col(c)
    return F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))
    ).otherwise(text)


def srcset_first(c: Column | str, fallback: Column | str | None = None) -> Column:
    """URL of a ``srcset``'s first candidate when it is an http one, else the fallback."""
    first = F.substring_index(F.trim(F.substring_index(_col(c), ",", 1)), " ", 1)
    other = F.lit(None).cast("string") if fallback is None else _col(fallback)
    return F.when(F.startswith(first, F.lit("http")), first).otherwise(other)


def external_id(
    native: Column | str, slug: Column | str, date: Column | str, time: Column | str
) -> Column:
    """Native id, else ``slug@date[THHMM]`` with ``0000`` for an unknown time."""
    hhmm = F.coalesce(F.replace(_col(time), F.lit(":"), F.lit("")), F.lit("0000"))
    made = F.concat(
        _col(slug), F.lit("@"), F.date_format(_col(date), "yyyy-MM-dd"), F.lit("T"), hhmm
    )
    return F.coalesce(F.nullif(_col(native), F.lit("")), made)


def hashed_external_id(date: Column | str, time: Column | str, title: Column | str) -> Column:
    """Last-resort id; the title's hash is stable between runs."""
    hhmm = F.coalesce(F.replace(_col(time), F.lit(":"), F.lit("")), F.lit("0000"))
    return F.concat(
        F.date_format(_col(date), "yyyy-MM-dd"), F.lit("T"), hhmm, F.lit("-"),
        F.substring(F.md5(_col(title).cast("binary")), 1, 8),
    )


def join_parts(*parts: Column | str, sep: str = " — ") -> Column:
    """Distinct non-empty parts joined in order; null when nothing is left."""
    kept = F.array_distinct(
        F.filter(F.array(*[_col(p) for p in parts]), lambda p: p.isNotNull() & (F.trim(p) != ""))
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))
