"""Slices of one run of bytes, alike ones told by hashes of 64 bits, without a Python object for each."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Most bytes in a run.
MOST = 1 << 21
GROW, SHRINK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


RISE, FALL = powers(GROW, MOST + 2), powers(SHRINK, MOST + 2)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return (x ^ (x >> U(29))) * U(0x94D049BB133111EB)


def ranked(x: np.ndarray, width: int = 64) -> np.ndarray:
    """The order of numbers of `width` bits by their first 40 or so, and then by place: a sort of numbers beats one of places."""
    low = U((1 << len(x).bit_length()) - 1)
    z = ((x << U(64 - width)) & ~low) | np.arange(len(x), dtype=np.uint64)
    z.sort()
    return (z & low).astype(np.int64)


def ordered(x: np.ndarray, width: int = 64) -> np.ndarray:
    """The order of numbers, equal ones by place."""
    order = ranked(x, width)
    return order[np.argsort(x[order], kind="stable")]  # little is left to sort


def sums(run: np.ndarray) -> np.ndarray:
    """What hashes of slices are made of."""
    total = np.zeros(len(run) + 1, np.uint64)
    np.cumsum((run.astype(np.uint64) + U(1)) * RISE[: len(run)], out=total[1:])
    return total


def hashes(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each slice. In a run of more than MOST bytes they come from a digest: such a run is one slice that no shorter run has."""
    if len(run) > MOST:
        return np.array([int.from_bytes(hashlib.blake2b(run[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    total = sums(run)
    return spread((total[ends] - total[starts]) * FALL[starts] + (ends - starts).astype(np.uint64))


def kinds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers: the first of each kind, kinds ascending, and each one's kind."""
    order = ordered(h)
    h = h[order]
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def alike(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of slices of a run: the first of each kind, and each one's kind."""
    return kinds(hashes(run, starts, ends))


def words(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run: what stands between space and U+0009-U+000D."""
    inside = np.zeros(len(run) + 2, bool)
    inside[1:-1] = (run != 32) & ((run < 9) | (run > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]
