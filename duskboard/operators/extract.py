"""Extraction from page tables: fields, links, JSON-LD, repeated blocks, positioned words."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.functions.dates import parse_time_any
from duskboard.functions.text import clean_text, let, strip_html
from duskboard.operators.joins import broadcast_if_small
from duskboard.operators.sequences import forward_fill

#: Patterns tried in order per field; the first non-empty hit wins. Group 1 is the value.
PAGE_FIELDS: dict[str, list[str]] = {
    "title": [r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]*)"', r"(?is)<h1[^>]*>(.*?)</h1>",
              r"(?is)<title[^>]*>(.*?)</title>"],
    "h1": [r"(?is)<h1[^>]*>(.*?)</h1>"],
    "lang": [r'(?is)<html[^>]*\slang="([^"]*)"'],
    "image": [r'(?is)<meta[^>]+property="og:image"[^>]+content="([^"]*)"', r'(?is)<img[^>]+src="([^"]*)"'],
}


def extract_fields(
    pages: DataFrame, patterns: Mapping[str, Sequence[str]] = PAGE_FIELDS, html: str = "html"
) -> DataFrame:
    """One column per field next to the page's key columns; the page text itself is not carried on."""
    keys = [c for c in pages.columns if c != html]
    fields = []
    for name, tries in patterns.items():
        hits = [F.nullif(clean_text(F.regexp_extract(html, p, 1)), F.lit("")) for p in tries]
        fields.append(F.coalesce(*hits).alias(name))
    return pages.select(*keys, *fields)


def extract_links(pages: DataFrame, pattern: str = ".", html: str = "html") -> DataFrame:
    """Links of each page that match a pattern: one row per distinct link, at its first position."""
    keys = [c for c in pages.columns if c != html]
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a[^>]+href="([^"]*)"'), F.lit(1))
    wanted = F.array_distinct(F.filter(hrefs, lambda h: h.rlike(pattern)))
    return pages.select(*keys, F.posexplode(wanted).alias("pos", "href"))


JSONLD_EVENT = """struct<`@type`:string, name:string, url:string, startDate:string, endDate:string, image:string,
description:string, offers:struct<price:string, priceCurrency:string, availability:string>>"""


def extract_jsonld(pages: DataFrame, html: str = "html") -> DataFrame:
    """Events of the pages' JSON-LD scripts; a script that is not valid JSON yields nothing."""
    keys = [c for c in pages.columns if c != html]
    blocks = F.regexp_extract_all(
        html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1)
    )
    docs = pages.select(*keys, F.posexplode(blocks).alias("block_pos", "_doc"))
    return parse_jsonld(docs, "_doc").drop("_doc")


def parse_jsonld(df: DataFrame, doc: str) -> DataFrame:
    """Event objects of a JSON-LD text (one object or an array), one row each with its position."""
    as_array = F.when(F.startswith(F.trim(doc), F.lit("[")), F.col(doc)).otherwise(
        F.concat(F.lit("["), F.col(doc), F.lit("]"))
    )
    parsed = F.from_json(as_array, f"array<{JSONLD_EVENT}>", {"mode": "PERMISSIVE"})
    return df.select("*", F.posexplode(parsed).alias("pos", "item")).filter(F.col("item.@type") == "Event").select(
        *df.columns, "pos", "item"
    )


def extract_blocks(pages: DataFrame, open_pattern: str, html: str = "html") -> DataFrame:
    """Flat repeated cards: the text from each opening marker up to the next, with its position. For cards that lie in
    cards see :func:`extract_elements`."""
    keys = [c for c in pages.columns if c != html]
    parts = F.split(html, open_pattern)
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return pages.select(*keys, F.posexplode(blocks).alias("pos", "block"))


#: A page in pieces that make it up again: comments, scripts and styles as a whole, tags (a quoted ">" ends none), text.
PIECES = r"""(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
_CARD = "struct<pos: int, parent: int, start: int, end: int>"
_OPEN = f"struct<at: int, n: int, stack: array<struct<at: int, card: int>>, found: array<{_CARD}>>"


def extract_elements(pages: DataFrame, tag: str, opening: str, html: str = "html") -> DataFrame:
    """Cards that may lie in cards: every element ``tag`` whose opening tag matches ``opening``, whole, from its opening to
    its own closing tag: ``pos`` (order of the openings), ``parent`` (the card it lies in, else null), ``depth`` and ``block``.

    The page's tags are read once, with a stack of the open elements of this tag; others, closed or not, do not matter, nor
    do tags in comments and scripts. A closing tag without an opening one is skipped; an element that is never closed ends
    with the page. A self-closed tag is an empty card. A page without cards, or without text, gives no rows. Nothing is
    shuffled: a page is one row, and what is kept while it is read is the stack and the cards' places.
    """
    keys = [c for c in pages.columns if c != html]
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().alias("stack"), F.array().alias("found")).cast(_OPEN)

    def card_above(stack: Column) -> Column:
        return F.nullif(F.array_max(F.transform(stack, lambda e: e["card"])), F.lit(-1))

    def step(acc: Column, piece: Column) -> Column:
        opens = piece.rlike(rf"(?i)^<{tag}[\s/>]")
        closes = piece.rlike(rf"(?i)^</{tag}[\s>]")
        card, empty = opens & piece.rlike(opening), F.endswith(piece, F.lit("/>"))
        end = acc["at"] + F.char_length(piece)
        top = F.try_element_at(acc["stack"], F.lit(-1))
        rest = F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))

        def state(n: Column, stack: Column, found: Column) -> Column:
            return F.struct(end.alias("at"), n.alias("n"), stack.alias("stack"), found.alias("found")).cast(_OPEN)

        def place(number: Column, above: Column, at: Column) -> Column:
            return F.array(F.struct(number.alias("pos"), card_above(above).alias("parent"), at.alias("start"), end.alias("end")).cast(_CARD))

        number = acc["n"] + card.cast("int")
        pushed = F.concat(acc["stack"], F.array(F.struct(acc["at"].alias("at"), F.when(card, acc["n"]).otherwise(-1).alias("card"))))
        return (
            F.when(opens & ~empty, state(number, pushed, acc["found"]))
            .when(card, state(number, acc["stack"], F.concat(acc["found"], place(acc["n"], acc["stack"], acc["at"]))))
            .when(closes & (top["card"] >= 0), state(number, rest, F.concat(acc["found"], place(top["card"], rest, top["at"]))))
            .when(closes, state(number, rest, acc["found"]))
            .otherwise(state(number, acc["stack"], acc["found"]))
        )

    def finish(acc: Column) -> Column:
        def unclosed(e: Column, i: Column) -> Column:
            above = card_above(F.slice(acc["stack"], F.lit(1), i))
            return F.struct(e["card"].alias("pos"), above.alias("parent"), e["at"].alias("start"), acc["at"].alias("end")).cast(_CARD)

        left = F.filter(F.transform(acc["stack"], unclosed), lambda e: e["pos"] >= 0)
        return F.array_sort(F.concat(acc["found"], left))

    pieces = F.regexp_extract_all(html, F.lit(PIECES), F.lit(0))
    cards = F.aggregate(pieces, start, step, finish)

    def depth(all_cards: Column, e: Column) -> Column:
        return F.size(F.filter(all_cards, lambda o: (o["start"] < e["start"]) & (o["end"] >= e["end"])))

    placed = let(cards, lambda found: F.transform(found, lambda e: F.struct(
        e["pos"].alias("pos"), e["parent"].alias("parent"), depth(found, e).alias("depth"),
        F.substring(F.col(html), e["start"] + 1, e["end"] - e["start"]).alias("block"))))
    return pages.select(*keys, F.inline(placed))


def label_values(df: DataFrame, labels: str, values: str, out: str = "fields") -> DataFrame:
    """Parallel label and value lists to one map; the last of equal labels wins, extra ones are cut."""
    n = F.least(F.size(labels), F.size(values))
    pairs = F.arrays_zip(
        F.transform(F.slice(F.col(labels), F.lit(1), n), lambda x: F.upper(F.trim(x))).alias("k"),
        F.slice(F.col(values), F.lit(1), n).alias("v"),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(
        keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    )
    return df.withColumn(out, F.map_from_arrays(keys, last))


# What a class token says, by its form.
CLASS_FORMS = {
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "time": r"^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$",
    "id": r"^id_[0-9]+$",
    "genre": r"^dis_[0-9]+$",
    "session": r"^funcio-[0-9]+$",
}


def class_token(css: Column | str, form: str) -> Column:
    """First token of a class list that has a given form."""
    tokens = F.split(F.col(css) if isinstance(css, str) else css, " ")
    return F.try_element_at(F.filter(tokens, lambda t: t.rlike(CLASS_FORMS[form])), F.lit(1))


def class_tokens(df: DataFrame, css: str) -> DataFrame:
    """A class list's data: ISO date, HH:mm, numeric id, genre and session numbers."""

    def number(form: str) -> Column:
        digits = F.regexp_extract(class_token(css, form), "([0-9]+)$", 1)
        return F.nullif(digits, F.lit("")).try_cast("bigint")

    return (
        df.withColumn("class_date", class_token(css, "date").try_cast("date"))
        .withColumn("class_time", F.substring(class_token(css, "time"), 1, 5))
        .withColumn("class_id", number("id"))
        .withColumn("class_genre", number("genre"))
        .withColumn("class_session", number("session"))
    )


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Visible text of each page."""
    keys = [c for c in pages.columns if c != html]
    return pages.select(*keys, strip_html(html).alias("text"))


def line_pieces(pages: DataFrame, words: str = "words", doc: str = "doc_id", band: int = 20) -> DataFrame:
    """Pages that hold their words (``left_px, top_px, word``) in one array to pieces of lines:
    ``line_no`` and ``words``, the line's words in order.

    The array is sorted by line and cut where the line changes, so a page stays in its row until it is lines.
    """

    def cut(ws: Column) -> Column:
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ws, i)["line_no"] != F.get(ws, i - 1)["line_no"]))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(
            F.get(ws, i)["line_no"].alias("line_no"),
            F.transform(F.slice(ws, i + 1, F.coalesce(F.get(at, k + 1), F.size(ws)) - i),
                        lambda w: F.struct(w["left_px"].alias("left_px"), w["word"].alias("word"))).alias("words"))))

    placed = F.transform(words, lambda w: F.struct(
        F.floor(w["top_px"] / band).alias("line_no"), w["left_px"].alias("left_px"), w["word"].alias("word")))
    return pages.select(doc, F.inline(let(F.sort_array(placed), cut)))


def _side(words: str, is_right: bool, split_px: int) -> Column:
    wanted = F.filter(words, lambda w: (w["left_px"] >= split_px) == F.lit(is_right))
    return F.array_join(F.transform(wanted, lambda w: w["word"]), " ")


def _texts(lines: DataFrame, doc: str, words: str, split_px: int) -> DataFrame:
    return lines.select(doc, "line_no", _side(words, False, split_px).alias("left_text"), _side(words, True, split_px).alias("right_text"))


def reconstruct_lines(
    words: DataFrame, doc: str = "doc_id", band: int = 20, split_px: int = 400
) -> DataFrame:
    """Positioned words to lines: per band of pixels, the left and the right column's text.

    A band is one printed line, so what is gathered is bounded by the width of a page. Pages that hold their words in an
    array need no shuffle of them: see :func:`page_lines`.
    """
    row = F.struct("left_px", "word")
    lines = words.groupBy(doc, F.floor(F.col("top_px") / band).alias("line_no")).agg(F.array_sort(F.collect_list(row)).alias("_words"))
    return _texts(lines, doc, "_words", split_px)


def page_lines(pages: DataFrame, words: str = "words", doc: str = "doc_id", band: int = 20, split_px: int = 400) -> DataFrame:
    """The lines of :func:`reconstruct_lines` for pages that hold their words in one array.

    Lines of a page of one row are made where it is read. Only pages of several rows, found by counts of their ids, are
    gathered line by line from the rows' pieces.
    """
    repeated = pages.groupBy(F.col(doc).alias("_doc")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_doc")
    repeated, same = broadcast_if_small(repeated), F.col(doc).eqNullSafe(F.col("_doc"))
    whole = line_pieces(pages.join(repeated, same, "left_anti"), words, doc, band)
    pieces = line_pieces(pages.join(repeated, same, "left_semi"), words, doc, band)
    merged = pieces.groupBy(doc, "line_no").agg(F.array_sort(F.flatten(F.collect_list("words"))).alias("words"))
    return _texts(whole.unionByName(merged), doc, "words", split_px)


DATE_LINE = r"^([0-9]{1,2})/([0-9]{1,2})"
TIME_LINE = r"^([0-9]{1,2}(:[0-9]{2}h?|h)\b)"
PRICE_LINE = r"([0-9]+)\s*€"


def schedule_segments(
    lines: DataFrame,
    doc: str = "doc_id",
    pos: str = "line_no",
    date_line: str = DATE_LINE,
    time_line: str = TIME_LINE,
) -> DataFrame:
    """Lines to events: a date line opens a day and its first event, a time line the day's next event.

    ``lines`` holds ``left_text`` and ``right_text``. A price line sets the event's price, a ``&``
    line and all others continue its text; an event whose opening line has no title takes the first
    continuing one. Events without a day, a time or a title are dropped. An event is known by its
    opening line; what is gathered is one event's own text.
    """
    left = F.lower(F.trim("left_text"))
    right = F.trim("right_text")
    is_date = left.rlike(date_line)
    marked = (
        lines.withColumn("_start", is_date | left.rlike(time_line))
        .withColumn("day_text", F.when(is_date, F.regexp_extract(left, date_line, 0)))
        .withColumn("start_line", F.when(F.col("_start"), F.col(pos)))
        .withColumn("_time", F.when(F.col("_start"), parse_time_any(F.regexp_replace(left, date_line, ""))))
        .withColumn("_price", F.when(~F.col("_start"), F.nullif(F.regexp_extract(left, PRICE_LINE, 1), F.lit(""))))
        .withColumn("_amp", F.startswith(left, F.lit("&")))
    )
    opened = forward_fill(marked, ["day_text", "start_line"], doc, pos).filter(F.col("start_line").isNotNull())
    aside = F.col("_price").isNotNull() | F.col("_amp")
    text = F.when(right != "", right).when(~aside & (left != ""), F.trim("left_text"))
    piece = F.when(
        ~F.col("_start") & text.isNotNull(),
        F.struct(F.col(pos).alias("p"), text.alias("t"), (~aside & (right != "")).alias("plain")),
    )
    events = opened.groupBy(doc, "start_line").agg(
        F.max("day_text").alias("day_text"),
        F.max("_time").alias("start_time"),
        F.max(F.when(F.col("_start"), right)).alias("_title"),
        F.max_by("_price", F.when(F.col("_price").isNotNull(), F.col(pos))).alias("_price"),
        F.array_sort(F.collect_list(piece)).alias("_pieces"),
        F.count("*").alias("n_lines"),
    )
    plain = F.filter("_pieces", lambda s: s["plain"])
    late = F.when(F.col("_title") == "", F.try_element_at(plain, F.lit(1)))
    body = F.filter("_pieces", lambda s: F.coalesce(s["p"] != F.col("_late.p"), F.lit(True)))
    return (
        events.withColumn("_late", late)
        .select(
            doc, "start_line", "day_text", "start_time",
            F.coalesce(F.nullif("_title", F.lit("")), F.col("_late.t")).alias("title"),
            F.concat("_price", F.lit("€")).alias("price"),
            F.array_join(F.transform(body, lambda s: s["t"]), " ").alias("description"),
            "n_lines",
        )
        .filter(F.col("day_text").isNotNull() & F.col("start_time").isNotNull() & F.col("title").isNotNull())
    )


def attach_context(blocks: DataFrame, context: DataFrame, page: str = "page_id") -> DataFrame:
    """Page-level facts on every block of the page."""
    return blocks.join(context, page)
