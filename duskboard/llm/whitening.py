"""Operator 13: embeddings whitened along their strongest components, by a bidiagonal qd solver.

Blockwise QR reduces the centred vectors to one triangle R, first in every task, then in a tree of tasks. Householder
reflections bring R to a bidiagonal B. The dqds algorithm finds the squares of its singular values by shifted quotient-
difference steps, which never subtract and so keep even the small ones accurate. Twisted factorisations of B'B less an
eigenvalue, joined where their remainder is smallest, give its eigenvectors; those of a cluster of eigenvalues are made
orthogonal and turned by one-sided Jacobi rotations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.session import stored

COMPONENTS, SCALE = 4, 256
#: Rows of a block of the QR reduction, and triangles that one task of the tree joins.
BLOCK, FAN = 4096, 16
#: Eigenvalues closer than this share of their size are a cluster.
NEAR = 1e-3
EPS = float(np.finfo(float).eps)
#: A singular value below this share of the largest, times the dimensions, is rounding.
ROUNDING = 100 * EPS
TINY = float(np.finfo(float).tiny)
LARGEST = (1 << 63) - 1


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, W) with r = U B W' for some orthogonal U."""
    a, n = r.astype(float).copy(), r.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound below the smallest eigenvalue: one over the trace of the inverse."""
    f, trace = 1.0, 0.0
    for i, qi in enumerate(q):
        if i:
            f = 1 + f * e[i - 1] / q[i - 1]
        if qi < TINY:
            return 0.0
        trace += f / qi
    return 1 / trace if trace < math.inf else 0.0


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; none if the shift was too large."""
    d, out_q, out_e = q[0] - shift, [], []
    for i, ei in enumerate(e):
        if d < 0:
            return None
        qi = d + ei
        t = q[i + 1] / qi if qi > 0 else 1.0
        out_q.append(qi)
        out_e.append(ei * t)
        d = d * t - shift
    if d < 0:
        return None
    return [*out_q, d], out_e


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The eigenvalues of B'B, the squared singular values of the bidiagonal B, falling."""
    found: list[float] = []
    waiting = [((diagonal * diagonal).tolist(), (above * above).tolist(), 0.0)]
    small = (10 * EPS) ** 2
    while waiting:
        q, e, sigma = waiting.pop()
        if len(q) > 1 and q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # the small ones come out at the end
        while q:
            cut = next((i for i in reversed(range(len(e))) if e[i] <= small * max(sigma, min(q[i], q[i + 1])) or e[i] < TINY), None)
            if cut is not None:
                if cut < len(q) - 2:
                    waiting.append((q[: cut + 1], e[:cut], sigma))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(q.pop() + sigma)
                    e.pop()
                continue
            if len(q) == 1:
                found.append(q.pop() + sigma)
                break
            shift = _lower_bound(q, e) * (1 - 8 * EPS * len(q))
            moved = _step(q, e, shift)
            if moved is None:
                shift, moved = 0.0, _step(q, e, 0.0)
            q, e = moved
            sigma += shift
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two factorisations of B'B - value: their multipliers from above and from below, and the remainder at every
    place where they can be joined."""
    n = len(diagonal)
    q, e, product = diagonal * diagonal, above * above, diagonal[:-1] * above
    safe = lambda x: x if x != 0 else TINY / EPS
    down, up, s, p = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = safe(s[i] + q[i])
        down[i] = product[i] / pivot
        s[i + 1] = e[i] * (s[i] / pivot) - value
    p[-1] = q[-1] - value
    for i in reversed(range(n - 1)):
        pivot = safe(e[i] + p[i + 1])
        up[i] = product[i] / pivot
        p[i] = q[i] * (p[i + 1] / pivot) - value
    return down, up, s + p + value


def _joined(down: np.ndarray, up: np.ndarray, r: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[r] = 1
    for i in reversed(range(r)):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, len(up)):
        z[i + 1] = -up[i] * z[i]
    return z


def _apply(diagonal: np.ndarray, above: np.ndarray, z: np.ndarray) -> np.ndarray:
    out = diagonal[:, None] * z
    out[:-1] += above[:, None] * z[1:]
    return out


def rotate(z: np.ndarray, bz: np.ndarray) -> np.ndarray:
    """Turns the orthonormal columns of z by one-sided Jacobi rotations until those of bz are orthogonal; by falling length."""
    z, bz = z.copy(), bz.copy()
    for _ in range(60):
        worst = 0.0
        for i in range(z.shape[1]):
            for j in range(i + 1, z.shape[1]):
                a, b, c = bz[:, i] @ bz[:, i], bz[:, j] @ bz[:, j], bz[:, i] @ bz[:, j]
                if abs(c) <= EPS * math.sqrt(a * b):
                    continue
                worst = max(worst, abs(c) / math.sqrt(a * b))
                zeta = (b - a) / (2 * c)
                t = math.copysign(1 / (abs(zeta) + math.hypot(1, zeta)), zeta)
                cos = 1 / math.hypot(1, t)
                turn = np.array([[cos, cos * t], [-cos * t, cos]])
                z[:, [i, j]], bz[:, [i, j]] = z[:, [i, j]] @ turn, bz[:, [i, j]] @ turn
        if worst <= 4 * EPS:
            break
    return z[:, np.argsort(-np.linalg.norm(bz, axis=0), kind="stable")]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The eigenvectors of B'B for its ``count`` largest eigenvalues, as columns."""
    out = np.zeros((len(diagonal), 0))
    while out.shape[1] < count:
        first = out.shape[1]
        last = first + 1
        while last < len(values) and values[last - 1] - values[last] <= NEAR * values[last - 1]:
            last += 1
        cluster: list[np.ndarray] = []
        for value in values[first:last]:
            for _ in range(3):  # Rayleigh's correction of the eigenvalue
                down, up, remainder = twisted(diagonal, above, float(value))
                r = int(np.argmin(np.abs(remainder)))
                z = _joined(down, up, r)
                value += remainder[r] / (z @ z)
            down, up, remainder = twisted(diagonal, above, float(value))
            for r in np.argsort(np.abs(remainder), kind="stable"):
                z = _joined(down, up, int(r))
                z /= np.linalg.norm(z)
                for _ in range(2):
                    for other in [*out.T, *cluster]:
                        z -= (other @ z) * other
                if np.linalg.norm(z) > 0.1:  # else it repeats a vector of the cluster: join elsewhere
                    break
            cluster.append(z / np.linalg.norm(z))
        z = np.stack(cluster, axis=1)
        out = np.concatenate([out, rotate(z, _apply(diagonal, above, z)) if last - first > 1 else z], axis=1)
    return out[:, :count]


def singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest squared singular values of the triangle r, and their right vectors as columns with the
    largest entry positive. Values that are nothing but rounding are left out."""
    size = np.abs(r).max(initial=0)
    if not size:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    diagonal, above, w = bidiagonalise(r / size)
    values = dqds(diagonal, above)
    count = min(count, int((values > (ROUNDING * len(values)) ** 2 * values[0]).sum()))
    vectors = w @ right_vectors(diagonal, above, values, count)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]
    return values[:count] * size * size, vectors * np.sign(largest)


def remaining(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has no null and no entry that is not finite; x has 256 times each entry,
    rounded down."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    return vectors.filter(v.isNotNull() & whole).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), x.alias("x"))


class Fit:
    """What is known of the fit list: its number of vectors and their exact sums. Small, whatever the input."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.sums, self.largest = n, sums, largest
        self.wide = n * largest + max(map(abs, sums), default=0)

    def matrix(self, x: pa.Array) -> np.ndarray:
        """Rows of x as numbers; shorter ones end in zeros."""
        ends = np.diff(x.offsets.to_numpy())
        flat = x.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(x), len(self.sums)), np.int64)
        out[np.arange(len(self.sums)) < ends[:, None]] = flat
        return out

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, each rounded once."""
        whole, part = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        exact = x.astype(object) if self.largest >> 61 else x
        return (exact - np.array(whole, exact.dtype)).astype(float) - np.array([p / self.n for p in part])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of (n x - S)^2; none where a long cannot hold one."""
        fits = x.shape[1] * self.wide**2 <= LARGEST
        kind = np.int64 if fits else object
        found = ((x.astype(kind) * self.n - np.array(self.sums, kind)) ** 2).sum(axis=1)
        return found.tolist() if fits else [v if v <= LARGEST else None for v in found]


def fit_list(rows: DataFrame) -> tuple[DataFrame, Fit]:
    """Every distinct x once, and what is known of them."""
    fit = stored(rows.select("x").distinct(), "fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] = []
        for b in batches:
            x = b.column("x")
            at = np.arange(len(x.flatten())) - np.repeat(x.offsets.to_numpy()[:-1] - x.offsets[0].as_py(), np.diff(x.offsets.to_numpy()))
            flat = x.flatten().to_numpy(zero_copy_only=False)
            dims = int(at.max(initial=-1)) + 1
            total += [0] * (dims - len(total))
            high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
            np.add.at(high, at, flat >> 31)  # two halves, so that no sum of a batch is too large
            np.add.at(low, at, flat & 0x7FFFFFFF)
            for i in range(dims):
                total[i] += (int(high[i]) << 31) + int(low[i])
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(total)), pa.int64()), "part": pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))})

    parts = fit.mapInArrow(sums, "place long, part decimal(38,0)").groupBy("place").agg(F.sum("part").alias("total"))
    totals = {r["place"]: int(r["total"]) for r in parts.collect()}  # one row a dimension
    known = fit.agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0).cast("bigint"), lambda a, c: F.greatest(a, F.when(c < -LARGEST, LARGEST).otherwise(F.abs(c))))).alias("largest")).first()
    return fit, Fit(known["n"], [totals[i] for i in range(len(totals))], (known["largest"] or 0) + 1)


def _reduced(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    r = np.zeros((0, dims))
    for block in blocks:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def triangle(fit: DataFrame, known: Fit) -> np.ndarray:
    """R of the centred vectors: one triangle a task, joined FAN at a time by tasks until FAN are left."""
    dims = len(known.sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = (known.centred(known.matrix(b.column("x").slice(i, BLOCK))) for b in batches for i in range(0, b.num_rows, BLOCK))
        r = _reduced(blocks, dims)
        if len(r):
            cell = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def joined(some: pd.DataFrame) -> pd.DataFrame:
        r = _reduced((np.frombuffer(b).reshape(-1, dims) for b in some["r"]), dims)
        return pd.DataFrame({"cell": [int(some["cell"].iloc[0]) // FAN], "r": [r.tobytes()]})

    parts = stored(fit.mapInArrow(local, "cell long, r binary"), "triangles")
    while parts.count() > FAN:
        parts = stored(parts.groupBy(F.expr(f"cell div {FAN}")).applyInPandas(joined, "cell long, r binary"), "triangles")
    last = parts.orderBy("cell").collect()  # at most FAN triangles
    r = _reduced((np.frombuffer(b["r"]).reshape(-1, dims) for b in last), dims)
    return np.concatenate([r, np.zeros((max(0, dims - len(r)), dims))])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and each of the strongest components: vec_id, component (from 1, by falling
    variance), n (vectors of the fit list), deviation (the sum over dimensions of (n x - S)^2, exact; null where a long
    cannot hold it), whitened, explained (the component's share of all variance) and identity_error (the largest entry
    by which the covariance of the whitened fit list differs from the identity, one value).

    Rows without a vector, or with an entry that is null or not finite, are left out; so is every component whose
    variance is nothing but rounding, as when all vectors are equal, and then there may be no rows. Shorter vectors
    count as ending in zeros. The fit list has equal vectors once; every row comes out, repeated ids, null ids and equal
    rows too. Other columns are ignored; an empty table gives no rows.

    The driver sees sums, FAN triangles and directions: their size is that of the dimensions, not of the table.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = remaining(vectors, id_col, vector_col)
    fit, known = fit_list(rows)
    spark, n = vectors.sparkSession, known.n
    if not n or not known.sums:
        return spark.createDataFrame([], schema)
    r = triangle(fit, known)
    squares, directions = singular(r, components)
    k = len(squares)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = directions / np.sqrt(squares / n)
    explained = (squares / (r * r).sum()).tolist()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = known.centred(known.matrix(b.column("x"))) @ scaled
            values = np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)])
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int64()), "part": pa.array(values)})

    summed = fit.mapInArrow(moments, "place long, part double").groupBy("place").agg(F.sum("part").alias("total"))
    totals = np.array([r["total"] for r in summed.orderBy("place").collect()]) / n  # k + k * k numbers
    covariance = totals[k:].reshape(k, k) - np.outer(totals[:k], totals[:k])
    error = float(np.abs(covariance - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = known.matrix(part.column("x"))
                size = len(x) * k
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array([n] * size, pa.int64()),
                    pa.array(known.deviations(x), pa.int64()).take(pa.array(each)), pa.array((known.centred(x) @ scaled).reshape(-1)),
                    pa.array(explained * len(x)), pa.array([error] * size),
                ], names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(project, schema)
