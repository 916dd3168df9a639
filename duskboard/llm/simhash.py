"""Operator 11: near-duplicates by SimHash, found through pivot distance tables.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. For every distinct
fingerprint its distances to fixed reference fingerprints are computed once. By the triangle inequality two
fingerprints at most ``most`` bits apart differ by at most ``most`` in each of these coordinates, so a pair with a
larger coordinate difference is discarded, and only survivors are verified.

A table of distances alone would have to be compared with itself row by row. So pairs are formed in buckets only:
of ``blocks`` blocks of bits, ``most`` differing bits leave blocks - most equal, so a linked pair is in one bucket
of some choice of that many blocks. Nor is a bucket expanded into pairs. Its members are first compared with its
smallest one; only members of different components of these links are then compared with each other. In a bucket
too large for that, members are linked through midpoints: two fingerprints at most 4 bits apart have a common
neighbour at most 2 bits from each, and all fingerprints around one midpoint are linked to the smallest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.llm.components import components
from duskboard.llm.frames import id_and_text, slices
from duskboard.session import stored

SHINGLE, SEED, MOST = 4, 42, 4
REFERENCES = 16
#: Members of a bucket up to which they are compared pair by pair; larger ones are linked through midpoints.
LARGE = 128
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8. A text of fewer than four words is one shingle; one without words gives 0."""
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(SHINGLE, len(words))
    starts = np.append(0, ends[:-1])[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row with an id; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4 << 20):
            found = np.array([fingerprint(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def references(count: int = REFERENCES) -> list[int]:
    """Walsh functions: any two are 32 bits apart."""
    return [sum((bin(r & i).count("1") & 1) << i for i in range(64)) for r in range(1, count + 1)]


def _pivots(fp: Column, count: int = REFERENCES) -> list[tuple[str, Column]]:
    distance = lambda r: F.bit_count(fp.bitwiseXOR(F.lit(signed(r)))).cast("bigint")
    groups = [references(count)[i : i + 8] for i in range(0, count, 8)]
    packed = [sum((F.shiftleft(distance(r), 8 * k) for k, r in enumerate(own)), F.lit(0).cast("bigint")) for own in groups]
    return [(f"d{g}", c) for g, c in enumerate(packed)]


def pivot_table(prints: DataFrame, count: int = REFERENCES) -> DataFrame:
    """``prints`` (fp) with the distances to ``count`` references, eight to a long: columns d0, d1, ..."""
    return prints.select("fp", *(c.alias(n) for n, c in _pivots(F.col("fp"), count)))


def _beside(fp: str, out: str) -> Column:
    """The row that :func:`pivot_table` has for a column of fingerprints."""
    return F.struct(F.col(fp).alias("fp"), *(c.alias(n) for n, c in _pivots(F.col(fp)))).alias(out)


def _close(a: str, b: str, columns: list[str]) -> Column:
    """No coordinate differs by more than MOST, and then no more than MOST bits do."""
    part = lambda side, c, k: F.shiftright(F.col(f"{side}.{c}"), 8 * k).bitwiseAND(F.lit(255))
    largest = F.greatest(*(F.abs(part(a, c, k) - part(b, c, k)) for c in columns for k in range(8)))
    return (largest <= MOST) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= MOST)


def blocks_for(prints: int) -> int:
    """As many blocks as make fewer than one chance pair for eight fingerprints; more blocks mean more buckets a
    fingerprint is in, but longer keys. Every choice finds the same links."""
    for blocks in range(MOST + 1, 2 * MOST + 9):
        pairs = prints / 2 * math.comb(blocks, MOST) / 2 ** (64 * (blocks - MOST) / blocks)
        if pairs < 1 / 8:
            break
    return blocks


def masks(blocks: int) -> list[int]:
    """The bits of every choice of ``blocks - MOST`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(some) for some in itertools.combinations(block, blocks - MOST)]


def _unsent(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, as the other is, whatever size Spark takes it for: an explode counts as one row
    for each it is given, not as the dozens or the 2,081 it makes, and columns that repeat take few bytes in a file. By such
    a size a side that fills the driver would be broadcast."""
    return side.hint("merge")


def _midpoint_links(prints: DataFrame) -> DataFrame:
    """(a, b): every fingerprint with the smallest one of each midpoint at most two bits from both."""
    bit = lambda c: F.when(F.col(c) < 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftleft(1L, {c})"))
    first = prints.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(62))).alias("i"))
    from_j = F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("i") + 1)
    near = first.select("fp", "i", F.explode(F.sequence(from_j, F.lit(63))).alias("j"))
    near = near.select("fp", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("midpoint"))
    lowest = near.groupBy("midpoint").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    return _unsent(near).join(lowest.select("midpoint", "low"), "midpoint").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def link_prints(prints: DataFrame, blocks: int | None = None, large: int = LARGE) -> DataFrame:
    """(node, root): the component of every fingerprint of ``prints`` (fp, distinct) that is at most MOST bits from
    another; the root is the smallest fingerprint of the component, as a signed number."""
    table = stored(pivot_table(prints), "pivots")
    columns = [c for c in table.columns if c != "fp"]
    choices = masks(blocks or blocks_for(table.count()))
    bucket = ["choice", "key"]
    keys = table.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in choices))).alias(*bucket))
    found = keys.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("fp").alias("first")).filter("n > 1")
    members = stored(_unsent(keys).join(found, bucket), "members")

    # Distances are a function of the fingerprint: computed beside it, they need no join.
    stars = members.filter("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    sides = stars.select("a", "b", _beside("a", "x"), _beside("b", "y"))
    close = sides.filter(_close("x", "y", columns)).select("a", "b")
    # A fingerprint may be linked to the smallest ones of many buckets. These are linked to the smallest of them instead,
    # which many fingerprints say alike, so a crowd has about one link a member. Their number is that of the choices at most.
    held = close.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("bs")).select("a", "bs", F.get("bs", 0).alias("low"))
    ends = F.concat(F.array("a"), F.slice("bs", F.lit(2), F.greatest(F.size("bs") - 1, F.lit(0))))
    links = stored(held.select(F.explode(ends).alias("a"), F.col("low").alias("b")).distinct(), "links")
    roots = components(links)

    # What these links leave apart can only be linked within a bucket that holds several components.
    placed = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select(*bucket)
    rest = stored(_unsent(_unsent(placed).join(mixed, bucket, "left_semi")).join(table, "fp"), "rest")
    small = rest.filter(F.col("n") <= large)
    x, y = small.alias("x"), small.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket]
    pairs = _unsent(x).join(y, [*same, F.col("x.fp") < F.col("y.fp"), F.col("x.root") != F.col("y.root"), _close("x", "y", columns)])
    more = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    crowded = rest.filter(F.col("n") > large).select("fp").distinct()
    more = stored(more.unionByName(_midpoint_links(crowded)), "more")
    return roots if more.isEmpty() else components(links.unionByName(more))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, fp, component_id) for every row with an id: the smallest id among the rows whose fingerprints it is
    linked to, over any path of pairs at most MOST bits apart.

    A null text is empty; texts without words have fingerprint zero and are linked like any other. Rows with one
    fingerprint are linked, repeated rows come as often as they are, and a repeated id may have several components.
    Rows without an id are left out, as they cannot stand for a component. Other columns are ignored; an empty table
    gives no rows. Equal fingerprints are joined as one, so copies cost one row each.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    roots = link_prints(prints.select("fp"), **settings).withColumnRenamed("node", "fp")
    placed = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(placed.join(lowest, "root").select("fp", "component_id"), "fp")
