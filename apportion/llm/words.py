"""Hashes of words, shingles and byte strings, computed for whole arrays at once."""

from __future__ import annotations

import numpy as np

# White space that separates words: space and the control characters \t to \r.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 22


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(1024, 1 << int(n).bit_length())
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_bytes = Powers()
_words = Powers(0xD6E8FEB86659FD93)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.reach(len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def run_hashes(values: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """A hash of each run of ``length`` consecutive values, equal for equal runs."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(values, powers)
    return mixed((sums[length:] - sums[:n]) * powers.down[:n])


def byte_run_hashes(data: np.ndarray, length: int) -> np.ndarray:
    return run_hashes(data.astype(np.uint64) + np.uint64(1), length, _bytes)


def word_run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    return run_hashes(words, length, _words)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order. Long texts are taken in pieces."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _CHUNK, "right")))
        at, stop = starts[first], ends[last - 1]
        sums = prefix_sums(data[at:stop].astype(np.uint64) + np.uint64(1), _bytes)
        s, e = starts[first:last] - at, ends[first:last] - at
        out[first:last] = mixed((sums[e] - sums[s]) * _bytes.down[s])
        first = last
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """For each word a hash of it and up to ``size`` - 1 words before it.

    So a text of n words has n shingles, also where n < ``size``.
    """
    out = words.copy()
    for back in range(1, min(size, len(words))):
        out[back:] = out[back:] * np.uint64(0xC2B2AE3D27D4EB4F) + words[:-back]
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, values.dtype.type(np.iinfo(values.dtype).max))
    padded[:n] = values
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are smallest in some ``width`` consecutive ones, ties included.

    Any two stretches of ``width`` equal hashes pick the same positions, and
    every stretch of that length has at least one.
    """
    lows = sliding_min(hashes, width)
    if not len(lows):
        return np.zeros(0, dtype=np.int64)
    top = np.iinfo(hashes.dtype).max
    wide = np.full(len(hashes) + width - 1, top, dtype=hashes.dtype)
    # The greatest minimum over the windows that hold a position equals its hash
    # exactly if it is the smallest of one of them.
    wide[width - 1 : width - 1 + len(lows)] = ~lows
    wide[: width - 1] = top
    return np.flatnonzero(~sliding_min(wide, width)[: len(hashes)] == hashes)
