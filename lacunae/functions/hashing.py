"""Uniform and normal numbers keyed by seed and row key.

`rand(seed)` depends on the partitioning; a hash of the row key does not, so a
sample is the same on one core, on a cluster and after a lost executor.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(2**52)


def row_hex(seed: int, keys: Sequence[str], salt: str) -> Column:
    """32 hex digits for (seed, row key, salt).

    Without a key all rows would share one number, so that is an error.
    """
    if not keys:
        raise ValueError("Random numbers need the key columns of the rows.")
    parts = [F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(salt)]
    return F.md5(F.concat_ws(":", *parts))


def hex_unit(digits: Column, start: int = 1) -> Column:
    """13 hex digits from `start` as a number strictly inside (0, 1)."""
    whole = F.conv(F.substring(digits, start, 13), 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(_SCALE)


def row_unit(seed: int, keys: Sequence[str], salt: str) -> Column:
    """Uniform number in (0, 1) for one cell."""
    return hex_unit(row_hex(seed, keys, salt))


def row_normal(seed: int, keys: Sequence[str], salt: str) -> Column:
    """Standard normal number for one cell (Box-Muller on two hash slices)."""
    digits = row_hex(seed, keys, salt)
    radius = F.sqrt(F.lit(-2.0) * F.log(hex_unit(digits, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * hex_unit(digits, 14))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator on an array of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
