"""Operator 6: license notices by an exact set-similarity join, in built-in operations only.

A text block is a line; it matches a template if it holds the wanted share of the template's distinct words.
Words are ordered by their frequency over all blocks, the rarest first. A block and a template that share
enough words share one within their prefixes in that order, so only prefixes are joined; block length and the
positions of the shared word rule out more pairs before the overlap is counted. Words outside all templates
add to no overlap and are left out of the blocks beforehand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskboard.llm.native import lines_of, lower_ascii, with_computed

#: Fixed phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Lines of common license notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"
WORD = r"[^\x00-/:-@\[-`{-\x7F]+"
CONTAINMENT = 0.9


def words_of(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case; everything beyond ASCII counts as a letter."""
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, label string, text string")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text).withColumn("t", F.xxhash64("text"))


def match_blocks(
    docs: DataFrame, licenses: DataFrame, containment: float = CONTAINMENT, max_vocabulary: int = 10_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per block and template it holds: doc_id, t (a hash of the text), line, template, label, overlap, score.

    ``licenses`` has (template, label, text); their words are held as literals, so more than ``max_vocabulary`` of them
    are an error. Null texts have no blocks, a template without words matches nothing, equal rows give equal matches.
    """
    wanted = licenses.select("template", "label", F.array_distinct(words_of(F.coalesce("text", F.lit("")))).alias("words")).filter(F.size("words") > 0)
    listed = wanted.limit(max_vocabulary + 1).collect()
    vocabulary = sorted({w for r in listed for w in r["words"]})
    if len(vocabulary) > max_vocabulary:
        raise ValueError(f"the templates have over {max_vocabulary} words")
    out = "doc_id long, t long, line int, template int, label string, overlap int, score double"
    if not vocabulary:
        return docs.sparkSession.createDataFrame([], out)
    least = {r["template"]: max(1, math.ceil(containment * len(r["words"]) - 1e-9)) for r in listed}
    lines = _keyed(docs, id_col, text_col).select("doc_id", "t", F.posexplode(lines_of(F.col("text"))).alias("line", "text"))
    own = F.filter(F.array_distinct(F.split(lower_ascii(F.col("text")), SEPARATORS)), lambda w: w.isin(vocabulary))
    long = lines.filter(F.char_length("text") >= min(least.values()))
    blocks = with_computed(long, words=own).select("doc_id", "t", "line", "words")
    blocks = blocks.filter(F.size("words") >= min(least.values()))
    counts = {r[0]: r[1] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes, sizes = [], []
    for r in listed:
        ordered = sorted(rank[w] for w in r["words"])
        need = least[r["template"]]
        sizes.append((r["template"], r["label"], need, len(ordered), ordered))
        prefixes += [(w, r["template"], place, len(ordered), need) for place, w in enumerate(ordered[: len(ordered) - need + 1])]
    spark = docs.sparkSession
    index = spark.createDataFrame(prefixes, "word int, template int, place int, size int, need int")
    rare = sorted({p[0] for p in prefixes})
    by_rank = sorted(vocabulary, key=rank.get)
    # Only blocks with a prefix word of some template can match; the rest need no order.
    possible = blocks.filter(F.exists("words", lambda w: w.isin([by_rank[i] for i in rare])))
    to_rank = F.create_map(*[F.lit(x) for w in by_rank for x in (w, rank[w])])
    ranked = with_computed(possible, ranks=F.sort_array(F.transform("words", lambda w: F.element_at(to_rank, w))))
    block_prefix = ranked.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - min(least.values()) + 1)).alias("at", "word"))
    length = F.size("ranks")
    rest = F.least(length - F.col("at") - 1, F.col("size") - F.col("place") - 1)
    pairs = (
        block_prefix.join(F.broadcast(index), "word")  # as long as the templates' prefixes
        .filter((length >= F.col("need")) & (F.col("at") <= length - F.col("need")) & (1 + rest >= F.col("need")))
        .select("doc_id", "t", "line", "ranks", "template")
    )
    found = pairs.join(F.broadcast(spark.createDataFrame(sizes, "template int, label string, need int, size int, own array<int>")), "template")
    found = found.withColumn("overlap", F.size(F.array_intersect("ranks", "own"))).filter(F.col("overlap") >= F.col("need"))
    return found.select("doc_id", "t", "line", "template", "label", "overlap", (F.col("overlap") / F.col("size")).alias("score")).distinct()


def find_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, t, n_words and ``places``, an array of (word, label), the word a phrase
    starts at, counted from 0. A null text has no words."""
    df = _keyed(docs, id_col, text_col)
    low = F.lower("text")
    has = lambda *some: [low.contains(w) for w in some]
    maybe = F.lit(False)
    for phrase, _ in PHRASES:
        every = F.lit(True)
        for one in has(*sorted(set(phrase.split()), key=len)[-2:]):
            every = every & one
        maybe = maybe | every
    words = F.when(maybe, words_of(F.col("text"))).otherwise(F.array().cast("array<string>"))
    df = with_computed(df, n_words=F.regexp_count("text", F.lit(WORD)).cast("bigint"), words=words)

    def labelled(w: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES:
            first, *others = phrase.split()
            same = w == first
            for k, other in enumerate(others, 1):
                same = same & (F.get("words", i + k) == other)
            label = F.when(same, name).otherwise(label)
        return F.struct(i.alias("word"), label.alias("label"))

    places = F.filter(F.transform("words", labelled), lambda p: p["label"].isNotNull())
    return df.select("doc_id", "t", "n_words", places.alias("places"))


def find_licenses(docs: DataFrame, licenses: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: n_words, ``places`` of the fixed phrases, ``matched`` labels of the templates its blocks
    hold, and the score: 1 with a phrase, else the largest share of a matched template, else 0. Repeated rows are
    judged alike, ids may be null, other columns are ignored."""
    phrases = find_phrases(docs, id_col, text_col)
    matches = match_blocks(docs, licenses, containment, id_col=id_col, text_col=text_col)
    found = matches.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_set("label").alias("matched"), F.max("score").alias("best"))
    joined = phrases.join(found, phrases["doc_id"].eqNullSafe(found["d"]) & (phrases["t"] == found["u"]), "left")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "places", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"), score.alias("score"))
