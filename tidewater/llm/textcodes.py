"""Words of a whole Arrow text batch as numpy arrays, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(h):
    """Scramble 64-bit codes (a bijection, so distinct codes stay distinct)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the batch and the n + 1 document offsets; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and document index of every word, in text order."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    cuts = inner[(inner > 0) & (inner < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word's bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = end - start
    code = left.astype(U) * U(0x9E3779B97F4A7C15)
    at, todo = start.copy(), np.arange(len(start))
    while len(todo):
        n = np.minimum(left[todo], 8)
        piece = eights[at[todo]] & (~U(0) >> ((8 - n).astype(U) * U(8)))
        code[todo] = mix(code[todo] ^ piece) * U(0x9FB21C651E98DF25)
        left[todo] -= n
        at[todo] += 8
        todo = todo[left[todo] > 0]
    return mix(code)


def rolling(code: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of ``size`` consecutive words (order counts)."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(size), U)
    for k in range(size):
        out = (out ^ (out >> U(29))) * U(0xBF58476D1CE4E5B9) + code[k:k + n]
    return mix(out)


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as an Arrow binary array."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take])])
