"""Words and other units of many texts at once, as numpy arrays.

The texts of a chunk are laid end to end as one array of code points.  Units are
(start, end) ranges in it, named by a 64-bit hash of their code points, so that work
that depends on a unit alone is done once per distinct unit of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

#: Code points laid out at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
CODE_POINTS = 0x110000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(lengths: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` code points together, or of one longer text."""
    ends = np.cumsum(lengths)
    first, done = 0, 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, last
        first, done = last, int(ends[last - 1])


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of each text in them."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), bounds


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return cp + ((cp - np.uint32(65)) < 26).astype(np.uint32) * np.uint32(32)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of true values that stay in one text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][filled], bounds[1:][filled] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


@cache
def _code_values() -> np.ndarray:
    return mix((np.arange(CODE_POINTS, dtype=np.uint64) + np.uint64(1)) * _STEP)


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        base = 0xD6E8FEB86659FD93
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK + 1), np.uint64(factor))
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


class Hasher:
    """64-bit hashes of ranges of code points; equal ranges have equal hashes anywhere."""

    def __init__(self, cp: np.ndarray) -> None:
        up, self._down = _powers(len(cp) + 1)
        self._sums = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(_code_values()[cp] * up[: len(cp)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(found + (end - start).astype(np.uint64) * _STEP) | np.uint64(1)


def hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Hasher(cp).of(start, end)


class Known:
    """Values of units seen before, in a table of fixed size; a newer unit replaces an older one."""

    def __init__(self, bits: int, width: int, dtype: type) -> None:
        self._shift = np.uint64(64 - bits)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._values = np.zeros((1 << bits, width), dtype)

    def get(self, names: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """A row of values for each hash; ``compute`` gets positions of distinct unknown ones."""
        slots = names >> self._shift
        values = self._values[slots]
        missing = np.flatnonzero(self._keys[slots] != names)
        if len(missing):
            distinct, first, back = np.unique(names[missing], return_index=True, return_inverse=True)
            new = compute(missing[first])
            values[missing] = new[back]
            slots = distinct >> self._shift
            self._keys[slots] = distinct
            self._values[slots] = new
        return values

    def clear(self) -> None:
        self._keys[:] = 0
