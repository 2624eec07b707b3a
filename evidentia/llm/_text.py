"""Words of whole Arrow batches as NumPy arrays, and bounded count tables.

A word is a maximal run of letters and digits of the lower-cased text. All
functions here work on the columns of one Arrow batch inside a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Characters handled at once; keeps the working arrays of a task at tens of MB.
SLICE_CHARS = 1_000_000


@lru_cache(1)
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


_powers: dict[str, np.ndarray] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < length:
        size = 1 << max(16, int(length - 1).bit_length())
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch holding about `most` characters each; a longer text stands alone."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if chars and chars + size > most:
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of several texts: row, hash, and where each stands in the code points of all of them."""

    def __init__(self, texts: list[str | None]):
        lowered = [t.lower() if t else "" for t in texts]
        self.codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = alnum_table()[self.codes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        up, down = _power_tables(len(self.codes) + 1)
        sums = np.empty(len(self.codes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        # Where each row ends, counting the line breaks between rows.
        self.bounds = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1) - 1
        self.rows = np.searchsorted(self.bounds, self.starts, side="right")


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, 64-bit hash of each word) in reading order; null counts as empty."""
    found = Words(texts)
    return found.rows, found.hashes


def shingles(rows: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of each run of `width` consecutive words, sorted by both."""
    if len(hashes) < width:
        return rows[:0], hashes[:0]
    whole = rows[: len(rows) - width + 1] == rows[width - 1 :]
    value = np.zeros(len(whole), np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(_MULTIPLIER) + hashes[k : len(hashes) - width + 1 + k])
    return distinct(rows[: len(whole)][whole], value[whole])


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) sorted by both."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])))
        rows, hashes = rows[new], hashes[new]
    return rows, hashes


class CountTable:
    """How often hashes occur, in 2**bits counters of 32 bits for a partition and 64 for all.

    The size is fixed, so the table may be broadcast. Hashes that share a
    counter add up: a count is never below the true one.
    """

    BLOCK = 1 << 14

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros(1 << bits, np.uint32)
        self._waiting: list[np.ndarray] = []
        self._size = 0

    def add(self, hashes: np.ndarray) -> None:
        self._waiting.append((hashes & np.uint64((1 << self.bits) - 1)).astype(np.int32))
        self._size += len(hashes)
        if self._size > 2_000_000:
            self.flush()

    def flush(self) -> None:
        if self._size:
            at, n = np.unique(np.concatenate(self._waiting), return_counts=True)
            self.counts[at] += n.astype(np.uint32)
        self._waiting, self._size = [], 0

    def blocks(self) -> Iterable[tuple[int, bytes]]:
        """The counters by block, all first bytes together: the many zero bytes compress well."""
        self.flush()
        size = min(self.BLOCK, len(self.counts))
        for k in range(len(self.counts) // size):
            part = self.counts[k * size : (k + 1) * size]
            if part.any():
                yield k, part.view(np.uint8).reshape(size, 4).T.tobytes()


def merged_counts(parts, bits: int) -> np.ndarray:
    """The counters of a DataFrame (block int, payload binary) of partial tables, summed by block.

    Only the merged table, of fixed size, reaches the driver.
    """
    size = min(CountTable.BLOCK, 1 << bits)

    def merge(key, table):
        total = np.zeros(size, np.int64)
        for payload in table.column("payload").to_pylist():
            total += np.ascontiguousarray(np.frombuffer(payload, np.uint8).reshape(4, size).T).view(np.uint32).ravel()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros(1 << bits, np.int64)
    for row in parts.groupBy("block").applyInArrow(merge, "block int, payload binary").toLocalIterator():
        counts[row.block * size : (row.block + 1) * size] = np.frombuffer(row.payload, np.int64)
    return counts
