"""Vectorised hashes over packed bytes: words, shingles, rolling windows. All arithmetic is modulo 2^64."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A random value per byte, so that equal sums of powers mean equal bytes.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ONE = np.uint64(1)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0.. and INVERSE^0.., at least n of each; kept for the next call."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = ONE
        have = _POWERS[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S[i] = sum of BYTE[data[k]] * BASE^k for k < i."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` bytes."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(data)
    n = len(data) - width + 1
    _, down = powers(n)
    return mixed((sums[width:] - sums[:n]) * down[:n])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) over each window of `width` values, from block-wise running values."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = -n % width
    edge = np.iinfo(values.dtype).max if best is np.minimum else 0
    blocks = np.concatenate((values, np.full(pad, edge, values.dtype))).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])
