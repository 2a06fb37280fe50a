"""Words of many texts at once, on their UTF-8 bytes with numpy.

Every separator of the word definitions used here is ASCII and lower-casing touches A-Z only, so working on bytes gives the
same words as working on code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]: everything but white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_P = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("inv", pow(_P, -1, 1 << 64))):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U(33))


@dataclass
class Words:
    """low: lower-cased bytes of all texts; word i is low[start[i]:end[i]]; text d has the words first[d] to first[d + 1]."""

    low: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        p, inv = powers(len(self.low) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(self.low) + 1, dtype=U)
            np.cumsum((self.low.astype(U) + U(1)) * p[: len(self.low)], out=run[1:])
            return mix((run[self.end] - run[self.start]) * inv[self.start] + (self.end - self.start).astype(U))

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and where each text starts and the last ends."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + n + 1]
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def words(strings: pa.Array, inside: np.ndarray) -> Words:
    data, bounds = raw(strings)
    low = LOWER[data]
    solid = np.zeros(len(low) + 2, dtype=bool)
    solid[1:-1] = inside[low]
    cut = np.zeros(len(low) + 1, dtype=bool)  # between byte i - 1 and byte i two texts meet
    cut[bounds] = True
    before, here = solid[:-1], solid[1:]
    start = np.flatnonzero(here & (~before | cut))
    end = np.flatnonzero(before & (~here | cut))
    return Words(low, bounds, start, end, np.searchsorted(start, bounds))
