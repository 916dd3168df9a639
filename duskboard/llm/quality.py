"""Operator 4: quality rules as a short-circuit cascade, in built-in expressions only.

Each rule rejects a text by one condition. On a bounded sample every rule is timed and its rejections are
counted; the rules then stand in one CASE expression by rejections per cost, so a text that one rule rejects
is not looked at by those behind it. The order decides only how fast a text is rejected, not whether.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.llm.native import SPACE_RUN, lines_of, strip, with_computed

#: The base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Limits of the cascade's rules.
MOST_SYMBOLS = 0.1  # symbols per word
MOST_DUP_LINES = 0.3  # of the lines with a word
WORD_LENGTH = (3, 10)  # mean
LEAST_ALPHABETIC = 0.75  # of the words have a letter
MOST_CAPITALS = 0.5  # of the characters in words
MOST_ELLIPSES = 0.3  # of the lines with a word
SAMPLE_ROWS = 300


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over text, words, lines and the base counts."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    n, lines = F.col("n_words"), F.size("lines")
    letters = F.filter("words", lambda w: w.rlike(r"\p{L}"))
    return [
        Rule("symbols", F.col("n_symbols") > MOST_SYMBOLS * n),
        Rule("duplicate_lines", F.col("n_dup_lines") > MOST_DUP_LINES * lines),
        Rule("word_length", ~(F.col("word_chars") / n).between(*WORD_LENGTH)),
        Rule("alphabetic", F.size(letters) < LEAST_ALPHABETIC * n),
        Rule("capitals", F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.col("word_chars")),
        Rule("ellipses", F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[ \x09-\x0D]*$"))) > MOST_ELLIPSES * lines),
    ]


def _measured(docs: DataFrame) -> DataFrame:
    """Adds words, lines with a word and the base counts to a column ``text``."""
    trimmed = strip(F.col("text"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    df = with_computed(docs, words=words, lines=F.filter(lines_of(F.col("text")), lambda x: strip(x) != ""))
    # A window of three words is known by a 64-bit hash; the last two places start none.
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    df = with_computed(
        df,
        n_words=F.size("words").cast("bigint"),
        word_chars=F.char_length(F.array_join("words", "")).cast("bigint"),
        n_symbols=F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        windows=F.slice(window, F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
    )
    # Equal windows stand beside each other when sorted; most texts have none and are not sorted.
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = with_computed(df, placed=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))
    rest = F.size("placed") - 1
    twice = F.zip_with(
        F.slice("placed", F.lit(1), rest), F.slice("placed", F.lit(2), rest),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)),
    )
    repeated = F.size(F.array_distinct(F.flatten(F.array_compact(twice))))
    df = with_computed(df, n_repeat_words=F.when(F.col("placed").isNull(), 0).otherwise(repeated).cast("bigint"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def order_rules(docs: DataFrame, given: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on at most ``sample_rows`` texts, the best first.

    A rule's cost is the time its condition takes over the sample beyond reading the sample, of two runs the
    shorter. Rules of the same worth stay in the given order.
    """
    spark = docs.sparkSession
    rows = docs.select("text").sample(0.2, seed=4).limit(sample_rows).collect()
    if not rows:
        return given
    sample = spark.createDataFrame(rows, "text string").coalesce(1)
    sample = _measured(sample).filter(~F.col("base_failed")).cache()

    def run(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        rejected = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, rejected

    empty = min(run(F.isnull("text"))[0] for _ in range(3))
    worth = {}
    for rule in given:
        runs = [run(rule.rejects) for _ in range(2)]
        worth[rule.name] = runs[0][1] / max(min(t for t, _ in runs) - empty, 1e-4)
    sample.unpersist()
    return sorted(given, key=lambda r: -worth[r.name])


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with the base counts, ``base_failed``, ``rejected_by`` (the first rule
    in cascade order that rejects it, null if none or if a base rule does) and ``kept``.

    A null or empty text has no words and fails the base rules. Rows are judged one by one where they are read,
    without a shuffle, so ids do not matter and repeated rows are judged alike.
    """
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    ordered = order_rules(df, rules(), sample_rows)
    df = _measured(df)
    cascade = F.when(F.col("base_failed"), None)
    for rule in ordered:
        cascade = cascade.when(rule.rejects, rule.name)
    df = df.withColumn("rejected_by", cascade)
    kept = ~F.col("base_failed") & F.col("rejected_by").isNull()
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", kept.alias("kept"))


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    return judge(docs, sample_rows, text_col).filter("kept").select("row.*")
