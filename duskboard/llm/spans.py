"""Spans that a scanner finds in texts, as a table and as a digest."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskboard.llm.frames import id_and_text, slices

#: kind, start and end in code points (end exclusive), score from 0 to 1.
Span = tuple[str, int, int, float]
SCHEMA = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def scan(docs: DataFrame, scanner: Callable[[], Callable[[str], list[Span]]], id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: its id and the spans of its whole text. ``scanner()`` is called once a task.

    A null text is empty, a null id stays null, repeated rows come as often as they are, other columns are ignored.
    Rows are scanned where they are read, in slices of a few MB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for b in slices(batches, 8 << 20):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def listed(kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end, joined by commas; of some kinds or of all."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
