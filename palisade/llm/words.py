"""Vectorised word rules over the bytes of an Arrow column: word spans and 64-bit hashes.

A word is a run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; it never crosses a row.
The hash is a polynomial over per-byte random values, finalised with the word's length.
"""

from __future__ import annotations

import functools

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20

_P = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte; powers of the base and of its inverse."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up, down = np.empty(_SLICE + 1, np.uint64), np.empty(_SLICE + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))
    return values, np.cumprod(up), np.cumprod(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; runs end at row boundaries."""
    if not len(is_word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(is_word))]
    begin[inner] = is_word[inner]
    end[inner - 1] = is_word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, computed over bounded slices of the data."""
    values, up, down = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        if ends[to - 1] - base > _SLICE:  # one span longer than a slice: chain its parts
            h = np.zeros(1, np.uint64)
            for p in range(int(base), int(ends[at]), _SLICE):
                part = values[data[p : min(p + _SLICE, int(ends[at]))]]
                h = mix(h + (part * up[: len(part)]).sum(dtype=np.uint64))
            out[at] = h[0]
        else:
            stop = ends[to - 1]
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(values[data[base:stop]] * up[: stop - base], out=sums[1:])
            out[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and per row the number of the first word (one more entry than rows)."""
    starts, ends = spans(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def window_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` values; order matters.  Doubles the run length each step."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    one, two = np.uint64(0xC2B2AE3D27D4EB4F + 2 * seed), np.uint64(0x165667B19E3779F9 + 4 * seed)
    whole, done, power, have = None, 0, mix(h + np.uint64(seed)), 1
    left = size
    while True:
        if left & 1:
            if whole is None:
                whole, done = power, have
            else:
                n = len(h) - done - have + 1
                whole, done = mix(whole[:n] * one + power[done : done + n] * two), done + have
        left >>= 1
        if not left:
            return whole[: len(h) - size + 1]
        n = len(power) - have
        power, have = mix(power[:n] * one + power[have:] * two), have * 2


def whole_windows(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Whether the window that starts at each of ``total - size + 1`` words stays in its row."""
    if total < size:
        return np.zeros(0, bool)
    keep = np.ones(total - size + 1, bool)
    for edge in np.unique(first[1:-1]):
        keep[max(0, edge - size + 1) : edge] = False
    return keep
