"""SimHash: fingerprints against plain counting, components against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duskboard.llm import queries, simhash

SMALL = "/root/testdata/sf0.001"


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(prints):
    """The smallest number of the component of each, by all pairs."""
    values = np.array([p % (1 << 64) for p in prints], np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 4):
            root[find(i)] = find(int(j))
    low = defaultdict(lambda: float("inf"))
    for i, p in enumerate(prints):
        low[find(i)] = min(low[find(i)], p)
    return {p: low[find(i)] for i, p in enumerate(prints)}


def test_all_documents(spark, documents):
    got = queries.op11_pivot_simhash(spark, SMALL).collect()
    prints = {doc: counted(text) for doc, text in documents}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints and len(got) == len(documents)
    roots = components(sorted(set(prints.values())))
    first = defaultdict(lambda: float("inf"))
    for doc, p in prints.items():
        first[roots[p]] = min(first[roots[p]], doc)
    assert {r["doc_id"]: r["component_id"] for r in got} == {doc: first[roots[p]] for doc, p in prints.items()}


def test_hashes_are_those_of_spark(spark):
    texts = ["one", "été ñ 火", "a b c d"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(xxhash.xxh64_intdigest(r["t"].encode(), 42) == r["h"] % (1 << 64) for r in rows)


def hard_prints(seed):
    """Chains, rings and crowds of fingerprints around few centres, and chance ones."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for most in (3, 5, 9):
            for _ in range(40):
                out.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, most))))
        step = centre
        for _ in range(12):  # each five bits from the last or just within four
            step ^= sum(1 << b for b in rng.sample(range(64), rng.choice((4, 4, 5))))
            out.add(step)
    out |= {rng.getrandbits(64) for _ in range(200)}
    return [simhash.signed(p) for p in out]


@pytest.mark.parametrize(("blocks", "large"), [(None, simhash.LARGE), (6, 3), (7, 20)])
def test_links_are_exact(spark, blocks, large):
    prints = hard_prints(blocks or 1)
    found = simhash.link_prints(spark.createDataFrame([(p,) for p in prints], "fp long"), blocks, large).collect()
    got = {r["node"]: r["root"] for r in found}
    assert {p: got.get(p, p) for p in prints} == components(prints)


def test_choices_of_blocks_cover_four_bits():
    for blocks in (5, 6, 7, 8):
        rng = random.Random(blocks)
        for _ in range(300):
            changed = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not m & changed for m in simhash.masks(blocks))
    assert [simhash.blocks_for(n) for n in (10, 50_000, 10**6, 10**8)] == sorted(simhash.blocks_for(n) for n in (10, 50_000, 10**6, 10**8))


def test_pivots_keep_every_link(spark):
    a, refs = random.Random(5).getrandbits(64), simhash.references()
    b = a ^ 0b1111
    assert max(abs((a ^ r).bit_count() - (b ^ r).bit_count()) for r in refs) <= 4
    assert all((x ^ y).bit_count() == 32 for i, x in enumerate(refs) for y in refs[:i])
    table = simhash.pivot_table(spark.createDataFrame([(simhash.signed(a),)], "fp long")).first()
    assert [(table[f"d{g}"] >> 8 * k) & 255 for g in range(2) for k in range(8)] == [(a ^ r).bit_count() for r in refs]


def test_hard_rows(hard, none):
    got = simhash.link_documents(hard).collect()
    kept = [(r["doc_id"], r["text"] or "") for r in hard.collect() if r["doc_id"] is not None]
    assert sorted((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == sorted((d, counted(t)) for d, t in kept)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    assert simhash.link_documents(none).count() == 0


def test_a_crowd_has_about_one_link_a_member(spark, monkeypatch):
    rng = random.Random(9)
    crowd = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2))) for _ in range(600)}
    seen = []
    follow = simhash.components
    monkeypatch.setattr(simhash, "components", lambda links: seen.append(links.count()) or follow(links))
    found = simhash.link_prints(spark.createDataFrame([(simhash.signed(p),) for p in crowd], "fp long")).collect()
    assert len({r["root"] for r in found}) == 1 and len(found) == len(crowd)
    assert seen[0] <= 1.2 * len(crowd)


def test_what_an_explode_makes_is_not_broadcast(spark, monkeypatch):
    """Spark takes it for as large as what it is made from, here a few kB."""
    prints = hard_prints(3)
    plans = {}
    write = simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or write(df, name))
    found = simhash.link_prints(spark.createDataFrame([(p,) for p in prints], "fp long"), 6, 20).collect()
    got = {r["node"]: r["root"] for r in found}
    assert {p: got.get(p, p) for p in prints} == components(prints)
    for name in ("members", "rest", "more"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]
