"""Vectors of Arrow batches as matrices, for the operators that compute on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrices(batch: pa.RecordBatch, vectors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) of each vector length in the list column number
    ``vectors``, without the vectors that are null or hold null or non-finite entries."""
    lists = batch.column(vectors)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
    for dim in np.unique(size[good]):
        rows = np.flatnonzero(good & (size == dim))
        yield rows, flat[(ends[rows] - dim)[:, None] + np.arange(dim)]


def stepped(values: np.ndarray, factor: int, bound: int) -> np.ndarray:
    """floor(factor * value) as integers; what lies beyond ``bound`` counts as ``bound``."""
    return np.clip(np.floor(values * factor), -bound, bound).astype(np.int64)


def least_widths(values: np.ndarray) -> np.ndarray:
    """Per row the least number of bytes (2, 4 or 8) in which an integer holds each of its entries."""
    most = np.abs(values).max(axis=1, initial=0)
    return np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)).astype(np.int32)


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """(bytes an integer, little-endian integers) of a matrix in the least width that holds it."""
    width = int(least_widths(values.reshape(1, -1))[0])
    return width, values.astype(f"<i{width}").tobytes()


def unpacked(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64)
