"""Operator 3: embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is rotated by ``k`` random rotations and stored as sign bits plus, for
the first ``ESTIMATE`` rotations, the correction factor <sign code, rotated vector>.  Bits
also make the bands that bring candidates together: bands of ``b`` bits (b grows with the
logarithm of the number of vectors, so chance buckets stay small) and as many bands as
keep a pair at the threshold from being missed with probability ``MISS``.  For two
vectors in a bucket the code of one and the rotation of the other give an unbiased
estimate of their inner product with a confidence bound; only pairs whose upper bound
reaches the threshold are computed exactly, in double precision.  A pair is counted in
the first band that holds it.  Large buckets are split into pairs of blocks; a task
returns link counts and the edges of a spanning forest, never a list of all pairs.

Defined cases: null or zero vectors and those with null or non-finite components link
with nothing; vectors of other lengths only link among themselves; equal vectors are one
representative and linked with one another; a component is named by its smallest vec_id
(a null vec_id only if all are null); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import block_pairs, column, components, landed, small_batches, whole_groups
from .textcodes import U, mix

THRESHOLD = 0.95
#: Chance that no band holds a pair at the threshold (nearer pairs are missed far less).
MISS = 1e-4
#: Rotations that take part in the estimate, and its confidence bound in standard errors.
ESTIMATE, SURE = 4, 5.0
BLOCK_ROWS = 512
#: Groups up to this size are compared many at a time; rows of whole pairs of blocks a task works on at once.
SMALL, CHUNK_ROWS = 24, 4096


def band_plan(vectors: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits a band, bands) for so many vectors."""
    bits = max(8, min(40, math.ceil(math.log2(max(2, vectors))) + 6))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices of a fixed seed, stacked by rows."""
    rng = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(x: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (packed) of every rotation and the correction factors of the first ones."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = unit @ turned.T
    dim = x.shape[1]
    k = min(ESTIMATE, len(turned) // dim)
    factors = np.abs(y[:, :k * dim]).reshape(len(x), k, dim).sum(2) / math.sqrt(dim)
    return np.packbits(y > 0, axis=1), factors


def band_codes(packed: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """One 64-bit code per band."""
    flat = np.unpackbits(packed, axis=1)[:, :bits * bands].reshape(len(packed), bands, bits)
    value = flat.astype(U) @ (U(1) << np.arange(bits, dtype=U))
    return mix(value + (np.arange(bands, dtype=U) << U(40)))


def sides(packed: np.ndarray, factors: np.ndarray, x: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the estimate weight[i] . turn[j] of a cosine, from the code and factors of i and the
    rotation of j: weight, turn, and the standard error that i brings."""
    n, dim = x.shape
    k = factors.shape[1]
    turn = x / np.linalg.norm(x, axis=1, keepdims=True) @ turned[:k * dim].T
    sign = np.unpackbits(packed, axis=1)[:, :k * dim] * 2.0 - 1
    weight = sign.reshape(n, k, dim) / (math.sqrt(dim) * factors[:, :, None] * k)
    error = np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / max(1, dim - 1))
    return weight.reshape(n, k * dim), turn, np.sqrt((error**2).sum(1)) / k


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1))
    out = np.empty(len(i))
    for a in range(0, len(i), 50_000):
        p, q = i[a:a + 50_000], j[a:a + 50_000]
        out[a:a + 50_000] = (x[p] * x[q]).sum(1) / (norm[p] * norm[q])
    return out


def open_pairs(start: np.ndarray, size: np.ndarray, weight, turn, error, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of rows of one group (rows start .. start + size) whose upper bound reaches
    the threshold: small groups of one size together, large ones by a matrix product."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(size[(size > 1) & (size <= SMALL)]):
        heads = start[size == n]
        one, two = np.triu_indices(n, 1)
        for a in range(0, len(heads), max(1, 20_000 // len(one))):
            h = heads[a:a + max(1, 20_000 // len(one)), None]
            i, j = (h + one).ravel(), (h + two).ravel()
            near = ((weight[i] * turn[j]).sum(1) + SURE * error[i] >= threshold) | ((weight[j] * turn[i]).sum(1) + SURE * error[j] >= threshold)
            found.append((i[near], j[near]))
    for a, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        near = weight[a:a + n] @ turn[a:a + n].T + SURE * error[a:a + n, None] >= threshold
        i, j = np.nonzero(np.triu(near | near.T, 1))
        found.append((i + a, j + a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def parents(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs: a row that each row hangs on (itself: a root)."""
    root = list(range(n))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    up = np.arange(n)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = up[max(a, b)] = min(a, b)
    return up


def raw_vectors(spark: SparkSession, embeddings: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, key (null for vectors that link with nothing), dim, vec (little-endian doubles)."""
    small_batches(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keys, dims, raws = [], [], []
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # a null is NaN
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            for a, b in zip(ends - size, ends, strict=True):
                v = flat[a:b]
                good = len(v) > 0 and np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and v @ v > 0
                raw = v.tobytes() if good else None
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
                dims.append(len(v))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())],
                                             ["vec_id", "key", "dim", "vec"])

    return embeddings.select(column(embeddings, "vec_id").cast("long").alias("vec_id"),
                             column(embeddings, name).alias("vec")).mapInArrow(task, "vec_id long, key binary, dim int, vec binary")


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = landed(spark, raw_vectors(spark, embeddings), "vectors-rows")
    base = landed(spark, rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "vectors-distinct")
    bits, bands = band_plan(base.count(), threshold)

    def turns(dim: int, held: dict) -> np.ndarray:
        if dim not in held:
            held[dim] = rotations(dim, max(ESTIMATE, -(-bits * bands // dim)))
        return held[dim]

    def matrix(raws) -> np.ndarray:
        return np.frombuffer(b"".join(raws.to_pylist()), "<f8").reshape(len(raws), -1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                packed, factors = encode(matrix(part.column(4)), turns(int(dim), held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([p.tobytes() for p in packed], pa.binary()),
                                                  pa.array([f.tobytes() for f in factors], pa.binary())],
                                                 ["key", "vec_id", "copies", "dim", "vec", "code", "factors"])

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column(1).to_numpy()):
                part = batch.filter(pa.array(batch.column(1).to_numpy() == dim))
                n = part.num_rows
                codes = mix(band_codes(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, -1), bits, bands) ^ U(dim))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)),
                     part.column(0).take(pa.array(np.repeat(np.arange(n), bands)))], ["bucket", "band", "key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for table in whole_groups(batches, sort, CHUNK_ROWS):  # a large bucket is many groups
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                yield linked(table.filter(pa.array(dims == dim)), turns(int(dim), held))

    def first_met(packed: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that no band before this one holds."""
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        codes = band_codes(packed[rows], bits, bands)
        keep = np.zeros(len(i), bool)
        for a in range(0, len(i), 20_000):
            one, two = at[a:len(i)][:20_000], at[len(i) + a:][:20_000]
            keep[a:a + 20_000] = (codes[one] == codes[two]).argmax(1) == band[i[a:a + 20_000]]
        return i[keep], j[keep]

    def linked(g: pa.Table, turned: np.ndarray) -> pa.RecordBatch:
        """Links of the rows of whole pairs of blocks of one vector length."""
        bucket, pi, pj, blk, band, copies = (g.column(c).to_numpy() for c in ("bucket", "pi", "pj", "blk", "band", "copies"))
        n = len(bucket)
        fresh = np.ones(n, bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (pi[1:] != pi[:-1]) | (pj[1:] != pj[:-1])
        start = np.flatnonzero(fresh)
        x = matrix(g.column("vec"))
        packed = np.frombuffer(b"".join(g.column("code").to_pylist()), np.uint8).reshape(n, -1)
        factors = np.frombuffer(b"".join(g.column("factors").to_pylist())).reshape(n, -1)
        i, j = open_pairs(start, np.diff(np.append(start, n)), *sides(packed, factors, x, turned), threshold)
        mine = (pi[i] == pj[i]) | (blk[i] != blk[j])  # rows of one block meet in the block's own pair
        i, j = i[mine], j[mine]
        i, j = first_met(packed, i, j, band)
        hit = cosines(x, i, j) >= threshold
        rows, at = np.unique(np.concatenate([i[hit], j[hit]]), return_inverse=True)
        one, two = at[:hit.sum()], at[hit.sum():]
        links, owned = np.zeros(len(rows), np.int64), copies[rows]
        np.add.at(links, one, owned[two])
        np.add.at(links, two, owned[one])
        keys, up = g.column("key").take(pa.array(rows)).to_pylist(), parents(len(rows), one, two)
        out = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in out], pa.binary()), pa.array([keys[up[k]] if up[k] != k else None for k in out], pa.binary()),
             pa.array(links[out])], ["key", "up", "links"])

    sort = ["bucket", "dim", "pi", "pj"]
    schema = "key binary, vec_id long, copies long, dim int, vec binary, code binary, factors binary"
    coded = landed(spark, base.mapInArrow(code, schema), "vectors-codes")
    buckets = coded.select("key", "dim", "code").mapInArrow(banded, "bucket long, band int, key binary")
    crowded = landed(spark, buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "vectors-crowded")
    met = buckets.join(crowded, "bucket").join(coded.drop("vec_id"), "key")
    met = block_pairs(met, F.col("n"), BLOCK_ROWS, F.col("key"))
    links = landed(spark, met.select(*sort, "band", "blk", "key", "copies", "vec", "code", "factors").repartition(*sort)
                   .sortWithinPartitions(*sort, "key").mapInArrow(compare, "key binary, up binary, links long"), "vectors-links")
    named = components(spark, links.where("up is not null").select(F.col("key").alias("a"), F.col("up").alias("b")), "vectors-components")
    named = landed(spark, named.withColumnRenamed("node", "key").join(base.select("key", "vec_id"), "key"), "vectors-named")
    least = named.groupBy("root").agg(F.min("vec_id").alias("least"))
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    found = (base.select("key", F.col("vec_id").alias("first"), "copies").join(named.join(least, "root").select("key", "least"), "key", "left")
             .join(counted, "key", "left"))
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("least", "first", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
