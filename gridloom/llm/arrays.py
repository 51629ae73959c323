"""Numpy helpers for tasks that work on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice hold about ``max_bytes`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of a public-domain generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and the row of each byte."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    return data, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the row of each run of bytes without ASCII white space."""
    words = [t.split() for t in texts]
    counts = [len(w) for w in words]
    sums = np.fromiter(map(crc32, chain.from_iterable(words)), np.uint64, sum(counts))
    return mix64(sums), np.repeat(np.arange(len(texts)), counts)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (8 at most) that begin at each place but the last ones."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    packed = np.zeros(n, np.uint64)
    for i in range(size):
        packed |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return mix64(packed + np.uint64(size << 58))
