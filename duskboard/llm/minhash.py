"""Operator 1: near-duplicates by BagMinHash.

A text is the multiset of its five-word shingles. Every shingle has a Poisson process per dyadic range of its
weight, [0,1), [1,2), [2,4), ...; a point lies at a level of its range and counts if the level is below the
weight, so a range the weight only partly covers is thinned. Points are dealt to the components of the
signature; a component keeps its smallest. Two texts agree in a component with the probability of their
weighted Jaccard similarity, and a text stops drawing points once none can lower a component.

Texts with equal signatures of one band are candidates. No bucket is expanded into pairs: its members are
compared with its most central one, the multisets themselves. Buckets that still hold several classes are
then settled exactly: their texts are joined on the prefixes of their rarest shingles, which texts of the
wanted similarity must share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.llm.components import components
from duskboard.llm.frames import WordIds, id_and_text, slices
from duskboard.session import stored

WORD = re.compile(r"\w+")
SHINGLE, BANDS, ROWS = 5, 16, 4
SIMILARITY = 0.8
#: Counters of shingle frequencies; they only order shingles, any order gives the same links.
SKETCH_BITS = 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
SIGNED = "row long, doc_id long, t long, content binary, size long, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], ids: WordIds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles, ordered so. A text of fewer words is one shingle; one
    without words has none."""
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((ids[w] for text in words for w in text), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - SHINGLE + 1))
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) - first[text] + (ends - sizes)[text]
    h = np.full(len(at), len(texts) and SHINGLE, np.uint64)
    for k in range(SHINGLE):
        inside = at + k < ends[text]
        h = mix(h * _A + np.where(inside, flat[np.minimum(at + k, max(len(flat) - 1, 0))] if len(flat) else 0, k + 1).astype(np.uint64))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    return text[starts], h[starts], np.diff(np.append(starts, len(h)))


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The m components of each of n texts; a text without shingles keeps infinities."""
    out = np.full((n, m), np.inf)
    flat = out.reshape(-1)
    ranges = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    node = np.repeat(np.arange(len(text)), ranges)
    r = np.arange(len(node)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    doc, limit = text[node], weight[node]
    key = mix(shingle[node] + r.astype(np.uint64) * _A)
    low = np.where(r == 0, 0, 1 << np.maximum(r - 1, 0))
    width = np.maximum(low, 1)
    x = np.zeros(len(node))
    step = 0
    while len(doc):
        step += 1
        u = mix(key + np.array([step], np.uint64) * _C)
        v = mix(u + _A)
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
        level = low + ((v >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width).astype(np.int64)
        good = level < limit
        np.minimum.at(flat, doc[good] * m + ((v[good] & np.uint64(0xFFFFFF)) % np.uint64(m)).astype(np.int64), x[good])
        live = x < out.max(axis=1)[doc]
        doc, limit, key, low, width, x = (a[live] for a in (doc, limit, key, low, width, x))
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sign.view(np.uint64).reshape(len(sign), bands, rows)
    h = np.zeros(bits.shape[:2], np.uint64)
    for k in range(rows):
        h = mix(h * _A + bits[:, :, k])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted shingles, weights). Empty ones are unlike anything."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _batch(names: str, *columns) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in names.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sign(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches, 2 << 20):
            n = b.num_rows
            text, h, weight = shingles(b.column("text").to_pylist(), ids)
            sign = band_keys(signatures(n, text, h, weight, bands * rows), bands, rows).view(np.int64)
            size, content, other = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(size, text, weight)
            w = weight.astype(np.uint64)
            np.add.at(content, text, mix(h + w * _A))
            np.add.at(other, text, mix(h * _C + w))
            digests = np.stack([content, other], axis=1).astype("<u8")
            yield _batch(SIGNED, *(b.column(c) for c in ("row", "doc_id", "t")), [d.tobytes() for d in digests], size, list(sign))

    return texts.mapInArrow(run, SIGNED)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose multisets are similar enough; ``texts`` has (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in slices(batches, 1 << 20, "text_a"):
            both = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            places: dict[str, int] = {}
            at = [[places.setdefault(t, len(places)) for t in side] for side in both]
            text, h, weight = shingles(list(places), ids)
            cut = np.searchsorted(text, np.arange(len(places) + 1))
            bags = [(h[s:e], weight[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            good = [similarity(bags[i], bags[j]) >= least for i, j in zip(*at, strict=True)]
            yield _batch("a long, b long", b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good)))

    left = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _prefix_pairs(texts: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """All pairs of different classes that can be similar enough, by shared shingles of their prefixes.

    Texts of sizes s and t with similarity ``least`` or more share at least least / (1 + least) * (s + t) shingles,
    and s >= least * t. So each has a shared one among its first s - ceil(least * s) + 1, in any common order.
    """
    cells = np.uint64((1 << SKETCH_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = WordIds(), np.zeros(1 << SKETCH_BITS, np.int64)
        for b in slices(batches, 2 << 20):
            _, h, _ = shingles(b.column("text").to_pylist(), ids)
            seen += np.bincount((h & cells).astype(np.int64), minlength=len(seen))
        some = np.flatnonzero(seen)
        yield _batch("cell long, n long", some, seen[some])

    counted = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    frequency = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in counted.toLocalIterator():  # as many as the sketch has cells, whatever the input
        frequency[row[0]] = row[1]
    sent = texts.sparkSession.sparkContext.broadcast(frequency)
    names = "row long, size long, shingle long, occurrence long, place long"

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, often = WordIds(), sent.value
        for b in slices(batches, 1 << 20):
            text, h, weight = shingles(b.column("text").to_pylist(), ids)
            rows = b.column("row").to_numpy()
            cut = np.searchsorted(text, np.arange(b.num_rows + 1))
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (s, e) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                own, w = h[s:e], weight[s:e]
                size = int(w.sum())
                length = size - int(np.ceil(least * size - 1e-9)) + 1
                order = np.lexsort((own, often[(own & cells).astype(np.int64)]))
                # The w copies of a shingle are w elements: (shingle, 0), (shingle, 1), ...
                each = np.repeat(order, w[order])[:length]
                place = np.arange(len(each))
                copy = place - (np.cumsum(w[order]) - w[order])[np.searchsorted(np.cumsum(w[order]), place, "right")]
                for column, values in zip(out, (np.full(len(each), rows[i]), np.full(len(each), size), own[each].view(np.int64), copy, place), strict=True):
                    column.append(values)
            if out[0]:
                yield _batch(names, *(np.concatenate(c) for c in out))

    found = texts.select("row", "text").mapInArrow(prefixes, names).join(roots, "row")
    # An element that only one class holds pairs nothing; most are such. Of the others, the class with most rows is
    # paired with the rest only, never with itself.
    element = ["shingle", "occurrence"]
    held = found.groupBy(*element, "root").agg(F.count("*").alias("n"))
    shared = held.groupBy(*element).agg(F.count("*").alias("classes"), F.max(F.struct("n", "root")).alias("most"))
    shared = shared.filter("classes > 1").select(*element, F.col("most.root").alias("major"))
    found = stored(found.join(shared, element), "prefixes")
    side = lambda s, df: df.select(*element, *(F.col(c).alias(f"{s}_{c}") for c in ("row", "root", "size", "place")))
    pairs = side("a", found.filter("root <> major")).join(side("b", found), element).filter("a_root <> b_root")
    rest = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    need = F.ceil(least / (1 + least) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    fits = (F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size")) & (rest >= need)
    return pairs.filter(fits).select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")).distinct()


def _classes(first: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, root) of the rows that are linked to another; ``first`` has (row, bands), one row per distinct multiset."""
    bucket = ["band", "key"]
    keys = first.select("row", F.posexplode("bands").alias(*bucket))
    sizes = keys.groupBy(*bucket).count().filter("count > 1")
    members = stored(keys.join(sizes, bucket), "members")
    central = members.groupBy("row").agg(F.sum("count").alias("weight"))
    pivots = members.join(central, "row").groupBy(*bucket).agg(F.max(F.struct("weight", "row")).alias("most"))
    pairs = members.join(pivots, bucket).select(F.col("row").alias("a"), F.col("most.row").alias("b")).filter("a <> b").distinct()
    involved = members.select("row").distinct()
    own = stored(texts.select("row", "text").join(involved, "row", "left_semi").dropDuplicates(["row"]), "texts")
    links = stored(_verified(pairs, own, least), "pairs")
    roots = components(links)
    known = roots.withColumnRenamed("node", "row")
    placed = stored(involved.join(known, "row", "left").select("row", F.coalesce("root", "row").alias("root")), "placed")
    mixed = members.join(placed, "row").groupBy(*bucket).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    open_rows = stored(members.join(mixed.select(*bucket), bucket, "left_semi").select("row").distinct(), "open")
    left = own.join(open_rows, "row", "left_semi")
    more = stored(_verified(_prefix_pairs(left, placed, least), own, least), "pairs")
    return roots if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per distinct (doc_id, t): its ``class_id``, the smallest id among the documents it is linked to over any
    path of pairs with a weighted Jaccard similarity of ``least`` or more, and ``root``, which names the class: classes
    of different texts under one repeated id have one class_id but different roots.

    t is a hash of the text and tells rows with one id apart. Texts with equal multisets are one class from the
    start. Texts without words are linked to equal ones only, empty texts to nothing. Rows without an id are left out,
    as they cannot stand for a class. Repeated rows count once. Other columns are ignored; an empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "t"))  # names a row, as ids may repeat
    signed = stored(_sign(texts, bands, rows), "signed")
    full = signed.filter("size > 0")
    same = full.groupBy("content").agg(F.min(F.struct("doc_id", "row", "bands")).alias("first"))
    first = stored(same.select("content", "first.*"), "first")
    roots = _classes(first, texts, least).select(F.col("node").alias("row"), F.col("root").alias("linked"))
    placed = first.join(roots, "row", "left").select("content", "doc_id", F.coalesce("linked", "row").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = placed.join(lowest, "root").select("content", "class_id", "root")
    member = full.select("doc_id", "t", "content").join(classes, "content").select("doc_id", "t", "class_id", "root")
    bare = signed.filter("size = 0").select("doc_id", "t", "row")
    empty = F.col("t") == F.xxhash64(F.lit(""))
    firsts = stored(bare.filter(~empty).groupBy("t").agg(F.min(F.struct("doc_id", "row")).alias("first")), "bare")
    wordless = bare.filter(~empty).join(firsts, "t").select("doc_id", "t", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("root"))
    wordless = wordless.unionByName(bare.filter(empty).select("doc_id", "t", F.col("doc_id").alias("class_id"), F.col("row").alias("root")))
    return member.unionByName(wordless).distinct()


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the smallest id, with all columns of ``docs``; of several rows with that id and
    class the one with the smallest hash of its text. Rows without an id stay, as they are in no class."""
    stay = classes.filter("doc_id = class_id").groupBy("root", "class_id").agg(F.min("t").alias("t"))
    own = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("bigint").alias("class_id"), own.alias("t"))
    kept = named.filter("class_id IS NOT NULL").join(stay, ["class_id", "t"], "left_semi").dropDuplicates(["class_id", "t"])
    return kept.unionByName(named.filter("class_id IS NULL")).select("row.*")
