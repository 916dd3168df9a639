"""Operator 8: token ids in binary shards with Elias-Fano document boundaries.

A shard holds the ids of a range of documents, one after another in ascending document order, as unsigned
integers as wide as the vocabulary needs. Behind them stand two Elias-Fano sequences, the ends of the
documents (in ids) and the document ids, and a footer. The manifest, one row per shard, is a Parquet table
beside the shards; sums over it place a shard among all ids.

A task writes its shard under a name of the attempt and then moves it to the name of its range, so a task
that runs again leaves one whole shard.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskboard.llm.eliasfano import EliasFano
from duskboard.llm.frames import id_and_text, slices
from duskboard.llm.tokens import END, worker_encoder

MAGIC = b"DUSKTOK1"
MANIFEST = "shard long, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """Reads one shard; ``ids(i)`` gives the ids of its i-th document."""

    def __init__(self, uri: str):
        fs, path = _place(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        length, magic = struct.unpack("<I8s", self.file.read_at(12, size - 12))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        self.footer = json.loads(self.file.read_at(length, size - 12 - length))
        at = size - 12 - length - self.footer["docs_bytes"]
        self.docs = EliasFano.from_bytes(self.file.read_at(self.footer["docs_bytes"], at))
        self.ends = EliasFano.from_bytes(self.file.read_at(self.footer["ends_bytes"], at - self.footer["ends_bytes"]))
        self.kind = np.dtype(self.footer["kind"])

    def __len__(self) -> int:
        return self.ends.n

    def doc_id(self, i: int) -> int | None:
        nulls = self.footer["nulls"]
        return None if i < nulls else self.docs.select(i - nulls) + self.footer["first_doc"]

    def doc_ids(self) -> list[int | None]:
        first, nulls = self.footer["first_doc"], self.footer["nulls"]
        return [None] * nulls + [v + first for v in self.docs.decode().tolist()]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, i: int) -> np.ndarray:
        return self.read(*self.bounds(i))

    def read(self, start: int, end: int) -> np.ndarray:
        wide = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * wide, start * wide), self.kind)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and the manifest below ``folder`` (a URI all executors see) and returns the manifest.

    A null or empty text is the end id 0 alone. Null ids come first; equal ids stay beside each other in the
    order of a hash of their texts; repeated rows are written as often as they come. Other columns are ignored.
    An empty table gives an empty manifest. Ids that many rows have, null too, are cut between shards by the hash of the
    text; only rows that are equal in both stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = worker_encoder(vocabulary), TaskContext.get()
        kind = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        fs, root = _place(folder)
        path = f"{root}/shard-{context.partitionId():06d}.tok"
        draft = f"{path}.{context.taskAttemptId()}"
        stream, ends, docs_seen, end = None, [], [], 0
        for batch in slices(batches, 4 << 20):
            if stream is None:
                stream = fs.open_output_stream(draft)
            some = [x + END for x in encoder.encode(batch.column("text").to_pylist())]
            stream.write(np.frombuffer(b"".join(some), "<u4").astype(kind).tobytes())
            ends.append(end + np.cumsum([len(x) // 4 for x in some]))
            end = int(ends[-1][-1])
            docs_seen.append(batch.column("doc_id"))
        if stream is None:
            return
        known = pa.chunked_array(docs_seen).combine_chunks()
        nulls = known.null_count
        known = known.drop_null().to_numpy()
        first = int(known[0]) if len(known) else 0
        coded_ends = EliasFano.of(np.concatenate(ends)).to_bytes()
        coded_docs = EliasFano.of(known.astype("<u8") - np.uint64(first % (1 << 64))).to_bytes()
        footer = json.dumps({"kind": kind, "first_doc": first, "nulls": nulls, "ends_bytes": len(coded_ends), "docs_bytes": len(coded_docs)}).encode()
        stream.write(coded_ends + coded_docs + footer + struct.pack("<I8s", len(footer), MAGIC))
        stream.close()
        fs.move(draft, path)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [f"{folder}/{path.rsplit('/', 1)[-1]}"], "n_docs": [len(known) + nulls], "n_ids": [end]})

    place, root = _place(folder)
    place.create_dir(root, recursive=True)
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the shards: its id, place among all ids, length and ids (unsigned 32-bit bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(uri)
                docs, ends = shard.doc_ids(), shard.ends.decode().astype("<i8")
                starts = np.concatenate([[0], ends[:-1]])
                i = 0
                while i < len(docs):
                    j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 20), "right")))
                    ids = shard.read(int(starts[i]), int(ends[j - 1])).astype("<u4").tobytes()
                    cut = [ids[4 * (a - starts[i]) : 4 * (b - starts[i])] for a, b in zip(starts[i:j], ends[i:j], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(docs[i:j], pa.int64()), "start": pa.array(starts[i:j] + base, pa.int64()),
                        "n_tokens": pa.array(ends[i:j] - starts[i:j], pa.int64()), "ids": pa.array(cut, pa.binary())})
                    i = j

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.repartition(max(1, manifest.count())).mapInArrow(run, ROWS)
