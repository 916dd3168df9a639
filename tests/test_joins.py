"""Joins whose keys are hot or whose sides are large."""

import random

import pytest
from pyspark.sql import functions as F

from duskboard.operators import joins as J


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit", [0, J.BROADCAST_BYTES])
def test_ids_to_titles(spark, limit):
    """An id in every row, unknown and null ids, rows without ids; by both ways."""
    rnd = random.Random(4)
    data = [(i, "x" * (i % 3), [1, None, rnd.randrange(40), 999, rnd.randrange(40)][: i % 6] if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(data, "k long, other string, ids array<long>")
    dim = spark.createDataFrame([(i, f"t{i}" if i != 7 else None) for i in range(40)], "id long, title string")
    got = rows(J.resolve_ids(df, "k", "ids", dim, "id", "title", "titles", limit))
    assert got == [(k, o, [f"t{i}" for i in ids or [] if i is not None and i < 40 and i != 7]) for k, o, ids in data]


def test_heavy_keys_are_not_shuffled(spark):
    left = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    joined = J.spread_join(left, right, "k")
    assert rows(joined) == sorted((5 if v % 2 == 0 else v, v, 50 if v % 2 == 0 else v * 10) for v in range(4000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J.spread_join(left, right, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 3 and "CartesianProduct" not in plan


def test_sides_are_measured_in_bytes(spark):
    few = spark.createDataFrame([(1, "a" * 5000, [1, 2])], "id long, t string, a array<int>")
    assert few.select(J.row_bytes(few).alias("n")).first().n > 5000
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(J.broadcast_if_small(few)) and not hinted(J.broadcast_if_small(few, max_bytes=4000))
    assert hinted(J.broadcast_if_small(few.limit(0), max_bytes=0))


def test_sessions_and_parents_without_any_from_one_join(spark):
    from pyspark.sql import functions as F

    from duskboard.operators import expand as E
    parents = spark.createDataFrame([(1, "p1"), (2, "p2"), (2, "p2b"), (None, "p")], "k long, t string")
    sessions = spark.createDataFrame([(1, "a"), (1, "b"), (9, "c"), (None, "d")], "s long, u string")
    out = E.join_with_fallback(parents, sessions, F.col("s") == F.col("k"), "s", [F.col("k"), F.col("u")], [F.col("k"), F.col("t").alias("t")])
    assert sorted((r.k or 0, r.t) for r in out.collect()) == [(0, "p"), (1, "a"), (1, "b"), (2, "p2"), (2, "p2b")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("limit", [0, 200, J.BROADCAST_BYTES])
def test_rows_of_one_key_stay_apart_and_whole(spark, limit):
    """Few titles: no row is shuffled. Many: frequent ids, an unknown one too, are sent, and rows move for the others only."""
    rnd = random.Random(5)
    data = [(i // 2, i, [rnd.randrange(60) + 10, i % 3, 999, None][: 4 - i % 2]) for i in range(400)] + [(1, 400, None), (1, 401, [])]
    df = spark.createDataFrame(data, "k long, other long, ids array<long>")
    dim = spark.createDataFrame([(i, f"t{i}") for i in range(60)] + [(2, "again"), (None, "t")], "id long, title string")
    names = {i: [f"t{i}"] for i in range(60)} | {2: ["again", "t2"]}
    want = sorted((k, o, [t for i in ids or [] for t in names.get(i, [])]) for k, o, ids in data)
    out = J.resolve_ids(df, "k", "ids", dim, "id", "title", "titles", limit)
    assert rows(out) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, ((_w") == 0 and plan.count("Join LeftOuter, (_w") == (0 if limit == J.BROADCAST_BYTES else 1), plan


def test_more_ids_than_said_are_an_error(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "k long, ids array<long>")
    dim = spark.createDataFrame([(1, "a")], "id long, title string")
    with pytest.raises(Exception, match="more than 2 ids"):
        J.resolve_ids(df, "k", "ids", dim, "id", "title", "titles", longest=2).collect()
    long = spark.createDataFrame([(1, [1] * 20), (2, [3, 1] * 9)], "k long, ids array<long>")
    assert rows(J.resolve_ids(long, "k", "ids", dim, "id", "title", "titles")) == [(1, ["a"] * 20), (2, ["a"] * 9)]
