"""Vectorised word hashing inside tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

ODD = 0x9E3779B97F4A7C15
BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 * BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; one long text makes a slice of its own."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if len(col) == 0:
            continue
        sizes = pc.fill_null(pc.cast(pc.binary_length(col), pa.int64()), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(col)], strict=True):
            yield batch.slice(int(a), int(b - a))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Such slices, each with its texts as bytes (null: None)."""
    for part in slices(batches, column, limit):
        col = part.column(part.schema.get_field_index(column))
        yield part, col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def word_hashes(texts: list, lower: bool = False) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of every text, all their 64-bit SipHash values in one array, and the offsets of the texts in it."""
    words = [(t.lower() if lower else t).split() if t else [] for t in texts]
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(flat, categorize=False).astype(np.uint64) if len(flat) else np.empty(0, np.uint64)
    return words, hashes, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, by Horner's rule."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = g * np.uint64(ODD) + h[j : j + n]
    return mix64(g + np.uint64(k))


def per_process(key, make: Callable):
    """``make()``, once for each worker process: tables and caches that later tasks of the process use again."""
    kept = sys.modules.setdefault("_meshwalk_process", types.ModuleType("_meshwalk_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
