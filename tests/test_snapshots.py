"""Versions of the store: whole or not at all, and pinned."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duskboard.sources import snapshots as S

DAY = dt.date(2026, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(i, venue, v, DAY) for i, venue, v in rows], "event_id long, venue_slug string, v int, start_date date")


def told(df):
    return sorted((r.event_id, r.venue_slug, r.v) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


FIRST = [(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "7", 1)]


def test_only_written_venues_are_replaced(spark, path):
    df = events(spark, *FIRST)
    assert S.versions(spark, path) == [] and told(S.read_events(spark, path, df.schema)) == []
    assert S.write_events(df, path) == 1
    assert S.write_events(events(spark, (1, "a", 2)), path) == 2
    got = S.read_events(spark, path, df.schema)
    assert told(got) == [(1, "a", 2), (3, "b", 1), (4, "7", 1)] and got.schema == df.schema


def test_a_venue_without_rows_becomes_empty(spark, path):
    S.write_events(events(spark, *FIRST), path)
    gone = spark.createDataFrame([("a",), ("b",)], "venue_slug string")
    df = events(spark, (9, "b", 3), (8, "c", 3))
    S.write_events(df, path, gone)
    assert told(S.read_events(spark, path, df.schema)) == [(4, "7", 1), (9, "b", 3)]
    S.write_events(df.limit(0), path, spark.createDataFrame([("7",), ("b",)], "venue_slug string"))
    assert told(S.read_events(spark, path, df.schema)) == []


def test_readers_stay_with_their_version(spark, path):
    df = events(spark, *FIRST)
    S.write_events(df, path)
    before = S.read_events(spark, path, df.schema)
    S.write_events(df.withColumn("v", F.lit(5)), path)
    assert told(before) == sorted(FIRST) and {v for _, _, v in told(S.read_events(spark, path, df.schema))} == {5}
    assert told(S.read_events(spark, path, df.schema, 1)) == sorted(FIRST)
    with pytest.raises(ValueError):
        S.read_events(spark, path, df.schema, 7)


def test_a_write_that_dies_changes_nothing(spark, path, monkeypatch):
    df = events(spark, *FIRST)
    S.write_events(df, path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, "_commit", killed)  # after the data, before the rename
        with pytest.raises(KeyboardInterrupt):
            S.write_events(df.withColumn("v", F.lit(5)), path)
    with pytest.raises(Exception, match="boom"):  # in the middle of the data
        S.write_events(df.withColumn("v", F.when(F.col("event_id") == 3, F.raise_error(F.lit("boom"))).otherwise(5).cast("int")), path)
    assert told(S.read_events(spark, path, df.schema)) == sorted(FIRST) and S.versions(spark, path) == [1]
    assert S.write_events(df.withColumn("v", F.lit(6)), path) == 2
    assert {v for _, _, v in told(S.read_events(spark, path, df.schema))} == {6}


def test_of_two_writers_one_fails(spark, path):
    df = events(spark, *FIRST)
    S.write_events(df, path)
    S.write_events(events(spark, (1, "a", 2)), path, base=1)
    with pytest.raises(S.WrittenMeanwhile):
        S.write_events(events(spark, (3, "b", 9)), path, base=1)
    assert told(S.read_events(spark, path, df.schema)) == [(1, "a", 2), (3, "b", 1), (4, "7", 1)]


def test_null_venues_and_cleaning(spark, path):
    df = events(spark, *FIRST, (5, None, 1))
    S.write_events(df, path)
    S.write_events(events(spark, (5, None, 2)), path)
    S.write_events(events(spark, (3, "b", 2)), path)
    want = [(1, "a", 1), (2, "a", 1), (3, "b", 2), (4, "7", 1), (5, None, 2)]
    assert sorted(((r.event_id, r.venue_slug, r.v) for r in S.read_events(spark, path, df.schema).collect())) == want
    assert S.gather(spark, path, df.schema) == 4
    assert S.forget_before(spark, path, 4) == [1, 2, 3] and S.versions(spark, path) == [4]
    assert sorted(((r.event_id, r.venue_slug, r.v) for r in S.read_events(spark, path, df.schema).collect())) == want
    assert len(list((Path(path) / "data").glob("write=*"))) == 1
    with pytest.raises(ValueError):
        S.forget_before(spark, path, 99)


def test_folders_do_not_grow_with_the_venues(spark, path):
    many = events(spark, *((i, f"v{i}", 1) for i in range(120)))
    S.write_events(many, path)
    S.write_events(events(spark, (5, "v5", 2)), path)
    assert all(len(list(w.glob("*="))) + len(list(w.glob("*=*"))) <= S.FOLDERS for w in (Path(path) / "data").glob("write=*"))
    assert told(S.read_events(spark, path, many.schema)) == sorted((i, f"v{i}", 2 if i == 5 else 1) for i in range(120))
