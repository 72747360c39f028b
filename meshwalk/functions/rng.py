"""Random numbers as a function of keys: the same for any partitioning, and repeatable in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str | int) -> Column:
    """In [0, 1): 52 bits of the MD5 of seed and keys joined by colons."""
    parts = [F.lit(str(seed))] + [(k if isinstance(k, Column) else F.lit(str(k))).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def normal(seed: int, *keys: Column | str | int) -> Column:
    """Standard normal by Box-Muller from the draws a and b of the keys."""
    u = F.greatest(uniform(seed, *keys, "a"), F.lit(2.0**-52))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * uniform(seed, *keys, "b"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform_array(seed: int, *keys) -> np.ndarray:
    """In [0, 1), 53 bits, for arrays or numbers as keys, inside a task: again a function of the keys alone."""
    h = _mixed(np.array([(seed + 0x9E3779B97F4A7C15) % 2**64], np.uint64))
    for k in keys:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(np.asarray(k)).astype(np.int64).view(np.uint64) + np.uint64(1))
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def normal_array(seed: int, *keys) -> np.ndarray:
    u = np.maximum(uniform_array(seed, *keys, 1), 2.0**-53)
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform_array(seed, *keys, 2))
