"""Small helpers the operators share: column picking, slices of Arrow batches, ids of words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as empty; other columns, whatever their names, stay behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], budget: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that no slice holds much more than ``budget`` bytes of text, or one row."""
    for batch in batches:
        start, size = 0, 0
        texts = batch.column(column)
        lengths = pa.compute.binary_length(texts).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > budget:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


class WordIds(dict):
    """64-bit ids of words; forgets them all when there are too many, which only costs hashing again."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def kept_in_worker(key: object, make):
    """What ``make()`` gave in this process before. Functions come anew with every task, so what outlives a
    task, such as a loaded vocabulary, hangs on a module of the process."""
    import sys
    import types

    state = sys.modules.setdefault("duskboard_worker_state", types.ModuleType("duskboard_worker_state"))
    if not hasattr(state, "kept"):
        state.kept = {}
    if key not in state.kept:
        state.kept[key] = make()
    return state.kept[key]
