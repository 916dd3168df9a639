"""Operator 9: lines that several documents hold stay in the first of them only, in built-in operations.

Hashes of the lines are range-partitioned and sorted by document and position behind the hash; in that order
the first row of a hash is its first occurrence, and the rows of other documents are dropped. What comes out
are keep bitmaps per document, not texts. A hash with so many rows that it would outweigh a partition is
found beforehand by counts and decided by its pre-aggregated first document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskboard.llm.native import lines_of, lower_ascii, strip, with_computed
from duskboard.session import stored

LEAST_CHARS = 10


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a hash of the text that tells rows with one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for every line whose key is long enough: the key as two 64-bit hashes, document and position."""
    lines = docs.filter("doc_id IS NOT NULL").select("doc_id", "t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    stripped = with_computed(lines.withColumnRenamed("line", "raw"), line=strip(F.col("raw")))
    keys = with_computed(stripped.filter(F.char_length("line") >= least_chars), key=lower_ascii(F.col("line")))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "doc_id", "t", "pos")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that loses lines: doc_id, t (a hash of its text), n_dropped and ``bitmap``.

    The bitmap has a bit for each line, set if the line goes, in words of 64 lines. It is an array of
    (gap, bits): so many words without a dropped line, then this word. Words behind the last are without, too.

    A line's key is the line without white space at its ends and with A-Z in lower case. A key of ``least_chars``
    code points or more stays in the document with the smallest id only, however often it stands there. A row
    without an id neither loses lines nor makes others lose them; rows with one id count as one document and share
    their fate line by line. A null text is one empty line.
    """
    spark = docs.sparkSession
    lines = stored(_lines(_keyed(docs, id_col, text_col), least_chars), "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # More rows than this and a hash weighs as much as a quarter of a partition; at most 4 * parts hashes do.
    most = lines.count() // (4 * parts) + 1
    cell = F.pmod("h1", F.lit(16 * parts)).alias("cell")
    cells = lines.groupBy(cell).count().filter(F.col("count") > most).select("cell")
    heavy = (
        lines.withColumn("cell", cell).join(F.broadcast(cells), "cell").groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") > most).select("h1", "h2", "first")
    )
    heavy = stored(heavy, "heavy")
    key = ["h1", "h2"]
    in_order = Window.partitionBy(*key).orderBy("doc_id", "t", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = lines.join(F.broadcast(heavy), key, "left_anti").repartitionByRange(parts, *key)
    firsts = ranged.withColumn("first", F.first("doc_id").over(in_order)).select("doc_id", "t", "pos", "first")
    hot = lines.join(F.broadcast(heavy), key).select("doc_id", "t", "pos", "first")
    dropped = firsts.filter("doc_id > first").unionByName(hot.filter("doc_id > first"))
    word = F.shiftright("pos", 6).alias("word")
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped.groupBy("doc_id", "t", word).agg(F.bit_or(bit).alias("bits"))
    entry = F.struct("word", "bits")
    found = words.groupBy("doc_id", "t").agg(F.sum(F.bit_count("bits")).alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("entries"))
    before = F.concat(F.array(F.lit(-1)), F.transform("entries", lambda e: e["word"]))
    gaps = F.zip_with("entries", F.slice(before, F.lit(1), F.size("entries")), lambda e, b: F.struct((e["word"] - b - 1).alias("gap"), e["bits"].alias("bits")))
    return found.select("doc_id", "t", "n_dropped", gaps.alias("bitmap"))


def _is_dropped(words: str, i: Column) -> Column:
    return F.coalesce(F.expr("1L") == F.getbit(F.get(words, F.shiftright(i, 6)), i % 64).cast("bigint"), F.lit(False))


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as a struct ``row``, with ``n_lines``, ``n_dropped`` and ``kept_text``."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("row")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    named = docs.select(rest, F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text).withColumn("t", F.xxhash64("text"))
    joined = named.join(bitmaps, ["doc_id", "t"], "left")
    zeros = lambda e: F.concat(F.array_repeat(F.lit(0).cast("bigint"), e["gap"]), F.array(e["bits"]))
    joined = with_computed(joined, lines=lines_of(F.col("text")), words=F.flatten(F.transform("bitmap", zeros)))
    kept = F.array_join(F.filter("lines", lambda line, i: ~_is_dropped("words", i)), "\n")
    return joined.select(
        "row", F.size("lines").cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
