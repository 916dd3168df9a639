"""Operator 7: benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: some positions count, the others are ignored, so a replaced
word breaks only the seeds that look at it. The masks are chosen so that every passage that counts has a seed
none of its replaced words breaks. Hashes of the benchmark's seeds are joined with those of the
documents where the documents are read; every hit is then verified word by word along its diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from duskboard.llm.frames import id_and_text, slices

WORD = re.compile(r"[^\W_]+")
#: One: the word counts; nought: it is ignored. All weigh six words. Every end of a best stretch matches more than
#: twice as many words as it misses, so its last twelve matches have at most five mismatches between them: 728
#: patterns, each of which one of these masks fits. More matches have such an end too; fewer need SHORT.
MASKS = ("10110111", "10010001111", "10100010111")
MASKS_FROM = 12
#: Behind its last mismatch a best stretch has three matches at least.
SHORT = 3
SCHEMA = "doc_id long, item_id long, n_matched long, n_words long, doc_word long, item_word long"
#: Text of the benchmark that one pass holds in every worker.
PASS_BYTES = 32 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _seeds(ids: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window whose counting words are known (not 0)."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = ids != 0
    whole = known[:n].copy()
    for o in mask[1:]:
        whole &= known[o : o + n]
    starts = np.flatnonzero(whole)
    h = np.full(len(starts), salt, np.uint64)
    for o in mask:
        h = (h ^ ids[starts + o].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return starts, h


def best_stretch(equal: np.ndarray, penalty: int = 2) -> tuple[int, int]:
    """Start and end of the stretch with the most matches less ``penalty`` times the mismatches."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -penalty))])
    lowest = np.minimum.accumulate(total)
    end = int(np.argmax(total - lowest))
    return int(np.argmin(total[: end + 1])), end


class SeedIndex:
    """The seeds of some benchmark items. Words that no item has are 0 and match nothing."""

    def __init__(self, items: list[tuple[int | None, str]], least_words: int):
        self.least = least_words
        self.ids: dict[str, int] = {}
        self.items = [i for i, _ in items]
        self.texts = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words(t)], np.int64) for _, t in items]
        spaced = MASKS if least_words >= MASKS_FROM else ("1" * max(1, min(SHORT, least_words)),)
        self.masks = [tuple(i for i, c in enumerate(m) if c == "1") for m in spaced]
        # An item of fewer words than a passage has a seed of all its words.
        for n in sorted({len(t) for t in self.texts if 0 < len(t) < least_words}):
            self.masks.append(tuple(range(n)))
        found = []
        for k, mask in enumerate(self.masks):
            for i, text in enumerate(self.texts):
                if k < len(spaced) or len(text) == len(mask):
                    at, h = _seeds(text, mask, k + 1)
                    found.append((h, np.full(len(h), i), at))
        hashes, item, place = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]

    @classmethod
    def of_state(cls, state: dict) -> SeedIndex:
        """From plain data, which a broadcast carries without needing this module on the executors."""
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def needed(self, item: int) -> int:
        return min(self.least, len(self.texts[item]))

    def overlaps(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, matching words, words, start in the text, start in the item), the best of each text and item."""
        split = [words(t) for t in texts]
        ends = np.cumsum([len(s) + 1 for s in split])
        get = self.ids.get
        ids = np.array([get(w, 0) for s in split for w in (*s, "")], np.int64)
        if not len(self.hashes) or not len(ids):
            return
        hits = set()
        for k, mask in enumerate(self.masks):
            starts, h = _seeds(ids, mask, k + 1)
            low = np.searchsorted(self.hashes, h, "left")
            hit = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == h)
            high = np.searchsorted(self.hashes, h[hit], "right")
            for start, a, b in zip(starts[hit].tolist(), low[hit].tolist(), high.tolist(), strict=True):
                hits.update((start - p, i) for i, p in zip(self.item[a:b].tolist(), self.place[a:b].tolist(), strict=True))
        best: dict[tuple[int, int], tuple] = {}
        for diagonal, i in hits:
            item = self.texts[i]
            # A window may straddle two texts, so both texts that the diagonal touches are looked at.
            first, last = np.searchsorted(ends, (max(diagonal, 0), min(diagonal + len(item), len(ids)) - 1), "right")
            for t in range(int(first), min(int(last), len(texts) - 1) + 1):
                begin, stop = (int(ends[t - 1]) if t else 0), int(ends[t]) - 1
                a, b = max(diagonal, begin), min(diagonal + len(item), stop)
                if a >= b:
                    continue
                equal = ids[a:b] == item[a - diagonal : b - diagonal]
                s, e = best_stretch(equal)
                matched = int(equal[s:e].sum())
                if matched >= self.needed(i):
                    row = (matched, s - e, -(a + s - begin), -(a - diagonal + s))
                    if row > best.get((t, i), ()):
                        best[t, i] = row
        for (t, i), (matched, length, at, place) in sorted(best.items()):
            yield t, i, matched, -length, -at, -place


def _passes(benchmark: DataFrame, least_words: int, pass_bytes: int, id_col: str, text_col: str) -> Iterator[SeedIndex]:
    """Indexes of the benchmark in blocks of a bounded size; every pass over the documents holds one."""
    items = id_and_text(benchmark, id_col, text_col)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // pass_bytes)
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        rows: list[Row] = own.orderBy("doc_id", "text").collect()
        yield SeedIndex([(r[0], r[1]) for r in rows if words(r[1])], least_words)


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, least_words: int = 12, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark item that share a passage: its matching words, its words, and where it
    starts in either (in words). A passage counts with ``least_words`` matching words, or all of a shorter item,
    where a mismatch costs two matches; its best stretch is reported, of equal ones the longer and earlier.

    The benchmark is taken in blocks of ``pass_bytes`` of text, so what workers hold is bounded. Null texts are
    empty and overlap nothing; null ids stay null; repeated rows give rows each; other columns are ignored.
    """
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in _passes(benchmark, least_words, pass_bytes, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = SeedIndex.of_state(sent.value)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for b in slices(batches, 4 << 20):
                ids = b.column("doc_id").to_pylist()
                found = [(ids[t], index.items[i], *rest) for t, i, *rest in index.overlaps(b.column("text").to_pylist())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        out = out.unionByName(id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA))
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, least_words: int = 12, pass_bytes: int = PASS_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no passage with the benchmark; see ``find_overlaps``."""
    for index in _passes(benchmark, least_words, pass_bytes, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(vars(index))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = SeedIndex.of_state(sent.value)
            for b in slices(batches, 4 << 20, text_col):
                bad = {t for t, *_ in index.overlaps([t or "" for t in b.column(text_col).to_pylist()])}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
