"""Whitening: the solver against numpy's, the operator against dense algebra over the whole table."""

import math

import numpy as np
import pytest

from duskboard.llm import queries, whitening

SMALL = "/root/testdata/sf0.001"
RNG = np.random.default_rng(7)
Q1, Q2 = (np.linalg.qr(RNG.normal(size=s))[0] for s in ((90, 24), (24, 24)))


def with_values(values):
    return Q1 * np.array(values) @ Q2


MATRICES = {
    "chance": RNG.normal(size=(90, 24)), "graded": RNG.normal(size=(90, 24)) * np.logspace(0, -11, 24), "graded up": RNG.normal(size=(90, 24)) * np.logspace(-11, 0, 24),
    "few rows": RNG.normal(size=(5, 24)), "one rank": np.outer(RNG.normal(size=90), RNG.normal(size=24)), "identity": np.eye(24),
    "repeated": with_values([3] * 6 + [1] * 18), "near": with_values([5 + 1e-8 * i for i in range(5)] + [1] * 19),
    "one column": RNG.normal(size=(9, 1)), "whole numbers": RNG.integers(-3, 3, size=(50, 3)).astype(float), "zero": np.zeros((4, 3)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name]
    r = np.linalg.qr(np.concatenate([a, np.zeros((a.shape[1], a.shape[1]))]), mode="r")
    squares, v = whitening.singular(r, 4)
    want = np.linalg.svd(a, compute_uv=False)
    rank = int((want > 1e-13 * max(want[0], 1e-300)).sum())
    assert len(squares) == min(4, rank)
    if rank:
        assert np.abs(np.sqrt(squares) - want[: len(squares)]).max() < 1e-13 * want[0]
        assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-13
        assert np.abs(a.T @ (a @ v) - v * squares).max() < 1e-12 * squares[0]


def test_small_values_are_accurate():
    diagonal, above = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = whitening.dqds(diagonal, above)
    # The product of the values is that of the diagonal; a solver that subtracts loses it.
    assert math.isclose(math.prod(got), math.prod(diagonal**2), rel_tol=1e-12)
    assert whitening.dqds(np.array([0.0, 1, 2]), np.array([1.0, 1])).min() < 1e-30


def dense(rows):
    x = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({v for _, v in x})
    n, dims = len(fit), max((len(v) for v in fit), default=0)
    sums = [sum(v[d] for v in fit) for d in range(dims)]
    centred = {v: np.array([(n * c - s) / n for c, s in zip(v, sums, strict=True)]) for v in fit}
    c = np.stack([centred[v] for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:4]
    out = []
    for i, v in x:
        for k, at in enumerate(order):
            deviation = sum((n * e - s) ** 2 for e, s in zip(v, sums, strict=True))
            out.append((i, k + 1, n, deviation, centred[v] @ vectors[:, at] / math.sqrt(values[at]), values[at] / values.sum()))
    return out


def compare(got, want):
    got = sorted(tuple(r)[:6] for r in got)
    want = sorted(want)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in range(1, 5):
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        sign = 1 if a @ b > 0 else -1
        assert np.abs(a - sign * b).max(initial=0) < 1e-9
    assert max((abs(a[5] - b[5]) for a, b in zip(got, want, strict=True)), default=0) < 1e-12


def test_all_embeddings(spark, con):
    rows = con.execute(f"select vec_id, embedding from '{SMALL}/embeddings.parquet'").fetchall()
    got = queries.op13_qd_whitening(spark, SMALL).collect()
    compare(got, dense(rows))
    assert max(r["identity_error"] for r in got) < 1e-10 and len({r["identity_error"] for r in got}) == 1


def test_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # several levels of the tree
    rows = [(i, [float(c) for c in RNG.normal(size=6)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), (104, [-math.inf] + [0.0] * 5)]
    same = [(200 + i, rows[0][1]) for i in range(50)] + [(3, rows[5][1]), (3, rows[5][1]), (300, [-0.0, 0.0, 1e-9, -1e-9, 0.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad + same], "vec_id long, embedding array<float>, n int, x string").repartition(9)
    got = whitening.whiten(df).collect()
    compare(got, dense([(r["vec_id"], r["embedding"]) for r in df.collect()]))
    assert got[0]["identity_error"] < 1e-10


def test_what_cannot_be_whitened(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = whitening.whiten(spark.createDataFrame(rows, schema))
        assert df.count() == 0 and len(df.columns) == 7
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (2, [1.0])], schema)).collect()
    assert [r["component"] for r in two] == [1, 2] * 3 and {r["n"] for r in two} == {3}
    big = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {(r["deviation"], r["identity_error"] < 1e-6) for r in big} == {(None, True), (65_537, True)}
