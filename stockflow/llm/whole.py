"""Vectors of whole numbers, exact at any magnitude: doubles while sums of products fit them, Python's integers beyond."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Whole numbers up to here, and sums of them, are exact as doubles.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def floored(column: pa.Array, factor: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows hold a vector of finite components, and floor(factor * component) of each such row, as doubles, which hold them exactly.

    factor is a power of two, so that the product is exact too. A vector that is so large that it leaves the doubles is not finite.
    """
    rows, out = np.zeros(len(column), bool), []
    for i, vector in enumerate(column):
        if vector.is_valid and vector.values.null_count == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(vector.values.to_numpy(zero_copy_only=False).astype(np.float64) * factor)
            if np.isfinite(x).all():
                rows[i] = True
                out.append(x)
    return rows, out


def integers(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python's integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def up(x: np.ndarray) -> np.ndarray:
    """As floats, not below x: rounded up by more than the errors of the square roots and sums that made x."""
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """As floats, neither above x nor below 0."""
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter(np.minimum(x * (1 - 1e-12), np.finfo(np.float32).max).astype(np.float32), np.float32(-np.inf)), 0)
