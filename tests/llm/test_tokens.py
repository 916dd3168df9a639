"""Packing and shards, against plain encoding by the tokenizers library."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from duskboard.llm import binary, packing, queries
from duskboard.llm.eliasfano import EliasFano
from duskboard.llm.tokens import Encoder
from duskboard.session import new_folder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)

    def encode(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    return encode


ENCODER = Encoder(queries.VOCABULARY, limit=50)


def test_the_added_token_has_its_own_id(plain):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>'s\n<|endoftext|>.", "two<|endoftext|><|endoftext|>  "):
        assert ENCODER.encode([text])[0] == plain(text) and struct.pack("<I", 50256) in plain(text)


UNTOUCHED = Tokenizer.from_file(queries.VOCABULARY)
SIGN = st.sampled_from(["<|endoftext|>", *"ab'é,._-9 \n\t\u00a0\x1c<|>sS"]) | st.characters(codec="utf-8")


@settings(max_examples=500, deadline=None)
@given(st.lists(SIGN, max_size=40).map("".join))
def test_parts_give_the_ids_of_the_whole(text):
    ids = UNTOUCHED.encode(text, add_special_tokens=False).ids
    assert ENCODER.encode([text])[0] == struct.pack(f"<{len(ids)}I", *ids)


def pieces_hold(rows, texts, plain, length):
    """Every id of every document lies in one piece, and sequences are filled from 0 without a gap."""
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, text in texts:
        ids, at = plain(text) + b"\0\0\0\0", 0
        for r in sorted(own.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4 and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * at])
        assert at == len(ids) // 4
    assert not own
    padding = tokens = 0
    for some in places.values():
        end = 0
        for offset, n in sorted(some):
            assert offset == end
            end += n
        assert end <= length
        tokens += end
        padding += 0 if end & (end - 1) == 0 else length - end
    assert padding == 0
    return tokens


def test_packing_of_all_documents(spark, documents, plain):
    rows = queries.op2_cost_packing(spark, SMALL).collect()
    pieces_hold(rows, documents, plain, 1024)


def test_packing_in_small_windows(spark, documents, plain):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = packing.pack(docs, queries.VOCABULARY, length=128, window_tokens=3000).withColumn("ids_crc32", F.crc32("ids"))
    pieces_hold(out.collect(), documents, plain, 128)


def test_packing_of_hard_rows(hard, none, plain):
    rows = packing.pack(hard, queries.VOCABULARY).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    given = [len(plain(r["text"])) // 4 + 1 for r in hard.collect()]
    assert sum(r["length"] for r in rows) == sum(given)
    assert packing.pack(none, queries.VOCABULARY).count() == 0


def test_longest_goes_to_the_cheapest():
    placed = packing.balance([5, 4, 3, 2, 2], [8, 8], 1.0, 0.1)
    assert sorted((p, s) for p, _, _, s, _ in placed)[:3] == [(0, 0), (1, 1), (2, 1)]
    assert sum(n for *_, n, _, _ in [(p, a, n, s, o) for p, a, n, s, o in placed]) == 16
    costs = [0.0, 0.0]
    for _, _, n, s, _ in placed:
        costs[s] += n + 0.1 * n * n
    assert abs(costs[0] - costs[1]) < 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_balance_places_everything(lengths):
    rooms = packing.capacities(sum(lengths), 64)
    placed = packing.balance(lengths, rooms, 1.0, 0.01)
    got, used = defaultdict(list), defaultdict(int)
    for piece, start, n, s, offset in placed:
        assert offset == used[s]
        used[s] += n
        got[piece].append((start, n))
    assert [used[s] for s in range(len(rooms))] == rooms
    for i, n in enumerate(lengths):
        at = 0
        for start, m in sorted(got[i]):
            assert start == at
            at += m
        assert at == n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values.sort()
    coded = EliasFano.from_bytes(EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.decode().tolist() == values
    for i in range(0, len(values), 7):
        assert coded.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 3000, 100_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 / len(values) < 14  # 64 in a plain table


def test_shards_of_all_documents(spark, documents, plain):
    rows = {r["doc_id"]: r for r in queries.op8_token_shards(spark, SMALL).collect()}
    assert len(rows) == len(documents)
    at = 0
    for doc, text in documents:
        ids = plain(text) + b"\0\0\0\0"
        r = rows[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_shards_of_hard_rows(spark, hard, none, plain):
    place = new_folder(spark, "shards")
    manifest = binary.write_shards(hard, queries.VOCABULARY, place)
    got = binary.read_shards(spark, place).orderBy("start").collect()
    want = [(r["doc_id"], plain(r["text"]) + b"\0\0\0\0") for r in hard.collect()]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in want), key=lambda d: (d is not None, d))
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((str(d), i) for d, i in want)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    shard = binary.Shard(manifest.filter("n_docs > 1").first()["path"])
    ids = shard.doc_ids()
    assert [shard.doc_id(i) for i in range(len(shard))] == ids and len(shard.ids(1)) == shard.bounds(1)[1] - shard.bounds(1)[0]
    empty = new_folder(spark, "shards")
    assert binary.write_shards(none, queries.VOCABULARY, empty).count() == 0 and binary.read_shards(spark, empty).count() == 0


def test_ids_of_many_rows_are_spread(spark, plain):
    """Two thirds of the rows have no id, the others one: all are written, and the larger group is cut."""
    texts = [f"heron number {i} waits" for i in range(3000)]
    docs = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    place = new_folder(spark, "shards")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join shards as small as these
    try:
        manifest = binary.write_shards(docs, queries.VOCABULARY, place).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(m["n_docs"] for m in manifest) < 1500  # the 2000 rows without an id are not one shard
    got = binary.read_shards(spark, place).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 2000 + [7] * 1000
    assert sorted(bytes(r["ids"]) for r in got) == sorted(plain(t) + b"\0\0\0\0" for t in texts)
