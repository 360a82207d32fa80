"""Operator 11: embedding whitening by principal components.

1. Entries become whole steps, x = floor(64 * c) + 1000000; equal x vectors are fitted once
   (a shuffle of the packed steps, partially aggregated).
2. Two distributed passes over the fit list: the sums, then the covariance of the vectors
   centred before they are multiplied.  They are centred on the nearest whole step to the
   mean, so that sums of products are exact integers in every task and in every order of
   adding; the part of the mean below a step is taken off exactly at the end.
3. The driver gets d * (d + 1) / 2 sums for vectors of length d, whatever the rows: Householder
   reflections make the covariance tridiagonal, bisection with Sturm counts finds the
   leading eigenvalues, inverse iteration their vectors, orthogonalised again within
   clusters of close eigenvalues, and the reflections turn them back.
4. The components (16 * d numbers) travel with the tasks; rows are projected as they are read.
   Another pass over the fit list takes the covariance of the projections, whose largest
   distance from the identity is reported.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and
null ids are kept; vectors of each length are fitted by themselves; an entry further than
``BOUND`` steps from 0 counts as ``BOUND``; components without variance (an eigenvalue
below ``FLAT`` of the trace) can't be whitened and are not returned, so a fit list of one
vector, and vectors of length 0, return no rows; a deviation beyond 64 bits is null;
repeated rows are all returned and fitted once; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import least_widths, matrices, stepped, unpacked
from .shared import column, landed, small_batches

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
BOUND = 1 << 40
#: Eigenvalues below this share of the trace count as zero.
FLAT = 1e-12
#: Eigenvalues nearer than this share of the largest are orthogonalised again.
CLUSTER = 1e-3


# -- eigenvectors of a symmetric matrix ------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflection vectors) of Householder's reduction of ``v``."""
    a, reflections = np.array(v, float), []
    n = len(a)
    for k in range(n - 2):
        u = a[k + 1:, k].copy()
        norm = np.sqrt(u @ u)
        if norm > 0:
            left = -np.copysign(norm, u[0])  # the entry that stays below the diagonal
            u[0] -= left
            u /= np.sqrt(u @ u)
            block = a[k + 1:, k + 1:]
            p = block @ u
            p -= (u @ p) * u
            block -= 2 * (np.outer(u, p) + np.outer(p, u))
            a[k + 1:, k] = 0
            a[k + 1, k] = left
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of ``x``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for k, d in enumerate(diagonal):
        q = d - x - (squares[k - 1] / q if k else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection."""
    n = len(diagonal)
    radius = np.abs(np.concatenate([off, [0]])) + np.abs(np.concatenate([[0], off]))
    low, high = np.full(count, (diagonal - radius).min()), np.full(count, (diagonal + radius).max())
    rank = n - 1 - np.arange(count)  # counted from the smallest
    slack = np.finfo(float).eps * max(1e-300, np.abs([low[0], high[0]]).max())
    low, high, squares = low - slack, high + slack, off**2
    for _ in range(200):
        mid = (low + high) / 2
        under = below(diagonal, squares, mid) > rank
        low, high = np.where(under, low, mid), np.where(under, mid, high)
        if (high - low <= slack).all():
            break
    return (low + high) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = b by elimination with row exchanges; zero pivots become tiny."""
    n, tiny = len(diagonal), np.finfo(float).eps * max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-300)
    d, up, up2, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, b.tolist()
    low = off.tolist()
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            factor = d[k] / low[k]
            d[k], d[k + 1], up[k], up[k + 1], up2[k] = low[k], up[k] - factor * d[k + 1], d[k + 1], -factor * up[k + 1], up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - factor * x[k + 1]
        else:
            d[k] = d[k] if abs(d[k]) > tiny else tiny
            factor = low[k] / d[k]
            d[k + 1] -= factor * up[k]
            x[k + 1] -= factor * x[k]
    for k in range(n - 1, -1, -1):
        d[k] = d[k] if abs(d[k]) > tiny else tiny
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (up2[k] * x[k + 2] if k + 2 < n else 0)) / d[k]
        if abs(x[k]) > 1e150:  # T - shift is nearly singular, which is the point; the length doesn't matter
            scale = 1 / abs(x[k])
            x = [y * scale for y in x]
    return np.array(x)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of a tridiagonal matrix for its ``values``, falling."""
    rng, n = np.random.default_rng(len(diagonal)), len(diagonal)
    out = np.zeros((len(values), n))
    size = max(np.abs(diagonal).max(initial=0), np.abs(off).max(initial=0), 1e-300)
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        shift = value - (k - first) * 4 * np.finfo(float).eps * size  # equal values get shifts of their own
        x = rng.uniform(-1, 1, n)
        for _ in range(5):
            x = solved(diagonal, off, shift, x)
            for _ in range(2):
                x = x - out[first:k].T @ (out[first:k] @ x)
            x /= np.sqrt(x @ x)
        out[k] = x
    return out


def components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the symmetric matrix ``v``, the ``count``
    largest, falling."""
    n, scale = len(v), float(np.abs(v).max(initial=0))
    if not scale:
        return np.zeros(min(count, n)), np.eye(n)[:count]
    diagonal, off, reflections = tridiagonal(v / scale)
    values = leading(diagonal, off, min(count, n))
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ u, u)
    return values * scale, vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


# -- distributed sums ------------------------------------------------------------------------------


def steps(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim, width, steps (packed x - OFFSET) per remaining row of (vec_id, embedding)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in matrices(batch, 1):
                z = stepped(values, STEPS, BOUND)
                widths = least_widths(z)
                for width in np.unique(widths):
                    own, size = widths == width, int(width) * z.shape[1]
                    raw, n = z[own].astype(f"<i{width}").tobytes(), int(own.sum())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[own])), pa.array([z.shape[1]] * n, pa.int32()), pa.array([width] * n, pa.int32()),
                                                      pa.array([raw[k * size:(k + 1) * size] for k in range(n)], pa.binary())], ["vec_id", "dim", "width", "steps"])

    return embeddings.mapInArrow(task, "vec_id long, dim int, width int, steps binary")


def whole(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, steps) of each vector length and width in columns dim, width, steps."""
    dims, widths = (batch.column(n).to_numpy() for n in ("dim", "width"))
    for dim, width in sorted(set(zip(dims.tolist(), widths.tolist(), strict=True))):
        at = np.flatnonzero((dims == dim) & (widths == width))
        raw = b"".join(batch.column("steps").take(pa.array(at)).to_pylist())
        yield dim, at, unpacked(width, raw).reshape(len(at), dim)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of integers, exact: by doubles or 64 bits where they hold it, else by Python's integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, len(a))
    if most < 1 << 53:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64)
    return a.T @ b if most < 1 << 63 else a.T.astype(object) @ b.astype(object)


def summed(fit: DataFrame, centre: dict[int, np.ndarray] | None) -> DataFrame:
    """Sums over the fit list per vector length ``dim`` as (dim, i, j, total): rows (-1, -1), entry
    i (i, -1), and with ``centre`` the products of the centred entries i <= j."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, z in whole(batch):
                n, one, two = held.get(dim, (0, 0, 0))
                if centre is not None:
                    z = z - centre[dim]
                    two = two + exact(z, z).astype(object)
                held[dim] = [n + len(z), one + exact(np.ones((len(z), 1), np.int64), z)[0].astype(object), two]
        for dim, (n, one, two) in held.items():
            rows = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(one))]
            if centre is not None:
                rows += [(i, j, two[i, j]) for i in range(dim) for j in range(i, dim)]
            for a in range(0, len(rows), 10_000):
                i, j, s = zip(*rows[a:a + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                                  pa.array([Decimal(int(x)) for x in s], pa.decimal128(38, 0))], ["dim", "i", "j", "total"])

    sums = fit.select("dim", "width", "steps").mapInArrow(task, "dim int, i int, j int, total decimal(38,0)")
    return sums.groupBy("dim", "i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))


def fitted(fit: DataFrame) -> dict[int, dict]:
    """Per vector length: n, S (sums of the steps), mean, eigenvalues, components, trace."""
    models: dict[int, dict] = {}
    for r in summed(fit, None).collect():  # a row an entry
        m = models.setdefault(r.dim, {"n": 0, "S": [0] * r.dim})
        if r.i < 0:
            m["n"] = int(r.total)
        else:
            m["S"][r.i] = int(r.total)
    for m in models.values():
        m["centre"] = [(2 * s + m["n"]) // (2 * m["n"]) for s in m["S"]]
        m["rest"] = [s - m["n"] * c for s, c in zip(m["S"], m["centre"], strict=True)]
    centre = {dim: np.array(m["centre"], np.int64) for dim, m in models.items()}
    products: dict[int, np.ndarray] = {dim: np.zeros((dim, dim)) for dim in models}
    for r in summed(fit, centre).where("j >= 0").collect():  # d * (d + 1) / 2 rows
        m = models[r.dim]
        n = m["n"]
        products[r.dim][r.i, r.j] = products[r.dim][r.j, r.i] = (n * int(r.total) - m["rest"][r.i] * m["rest"][r.j]) / (n * n)
    for dim, m in models.items():
        v = products[dim]
        m["trace"] = float(np.trace(v))
        if dim and m["trace"] > 0:
            values, vectors = components(v)
            keep = values > FLAT * m["trace"]
            m["values"], m["vectors"] = values[keep], vectors[keep]
        else:
            m["values"], m["vectors"] = np.zeros(0), np.zeros((0, dim))
    return models


def whitened(z: np.ndarray, m: dict) -> np.ndarray:
    """The whitened components of steps ``z``."""
    centred = (z - np.array(m["centre"], np.int64)) - np.array(m["rest"], float) / m["n"]
    return centred @ m["vectors"].T / np.sqrt(m["values"])


def deviations(z: np.ndarray, m: dict) -> list[int | None]:
    """Sum over the entries of (n * x - S)^2, exact; null if it needs more than 64 bits."""
    n = m["n"]
    most = n * (int(np.abs(z - np.array(m["centre"], np.int64)).max(initial=0)) + 1)
    kind = np.int64 if most * most * max(1, z.shape[1]) < 1 << 63 else object
    off = n * (z - np.array(m["centre"], np.int64)).astype(kind) - np.array(m["rest"], kind)
    return [int(s) if s < 1 << 63 else None for s in (off * off).sum(1)]


def identity_errors(fit: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """Per vector length the largest absolute entry of the whitened fit list's covariance minus
    the identity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, _, z in whole(batch):
                w = whitened(z, models[dim])  # centred; its mean is 0 but for rounding, and is taken off below
                one, two = held.get(dim, (0, 0))
                held[dim] = [one + w.sum(0), two + w.T @ w]
        for dim, (one, two) in held.items():
            rows = [(i, -1, one[i]) for i in range(len(one))] + [(i, j, two[i, j]) for i in range(len(one)) for j in range(len(one))]
            if rows:
                i, j, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.float64())],
                                                 ["dim", "i", "j", "total"])

    sums = fit.select("dim", "width", "steps").mapInArrow(task, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    found = {dim: (np.zeros(len(m["values"])), np.zeros((len(m["values"]),) * 2)) for dim, m in models.items()}
    for r in sums.collect():  # COMPONENTS^2 rows
        if r.j < 0:
            found[r.dim][0][r.i] = r.total
        else:
            found[r.dim][1][r.i, r.j] = r.total
    return {dim: float(np.abs(two / models[dim]["n"] - np.outer(one, one) / models[dim]["n"] ** 2 - np.eye(len(one))).max(initial=0)) for dim, (one, two) in found.items()}


def whiten(spark: SparkSession, embeddings: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per remaining row and
    component."""
    small_batches(spark)
    rows = steps(embeddings.select(column(embeddings, "vec_id").cast("long").alias("vec_id"), column(embeddings, name).alias("vec")))
    fit = landed(spark, rows.groupBy("dim", "width", "steps").agg(F.lit(1).alias("one")).drop("one"), "whitening-fit")
    models = fitted(fit)
    errors = identity_errors(fit, models)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, z in whole(batch):
                m, k = models[dim], len(models[dim]["values"])
                if not k:
                    continue
                n, ids = len(at), batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                dev = pa.array(deviations(z, m), pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, m["n"], np.int64)), dev, pa.array(whitened(z, m).ravel()),
                     pa.array(np.tile(m["values"] / m["trace"], n)), pa.array(np.full(n * k, errors[dim]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(task, schema)
