"""Vectorised word splitting and hashing over Arrow batches.

Texts stay UTF-8 bytes: every delimiter of the two word rules is ASCII, so a byte class decides
word membership for all code points, and A-Z are the only letters whose case is folded.
"""

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 18


class _Cache(dict):
    """What a process has worked out. It travels empty with the functions that use it."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _table(delimiters) -> np.ndarray:
    """Value of each byte in a word's hash: 0 outside words, else the lower-cased byte plus one."""
    t = np.arange(1, 257, dtype=np.uint64)
    for b in range(ord("A"), ord("Z") + 1):
        t[b] = b + 32 + 1
    for b in delimiters:
        t[b] = 0
    return t


#: Words [^\x20\x09-\x0D]+ and words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACED = _table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int):
    """p**i and p**-i modulo 2**64 for i < n."""
    p = 0x9E3779B97F4A7C15
    if _POWERS.get("n", 0) < n:
        size = max(n, SLICE_BYTES)
        up, down = np.full(size, p, np.uint64), np.full(size, pow(p, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept = (np.cumprod(up), np.cumprod(down))
        if size > 16 * SLICE_BYTES:  # a rare very long text: not kept
            return kept
        _POWERS.update(n=size, value=kept)
    return _POWERS["value"]


def columns(values: pa.Array):
    """The bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary()).fill_null(b"")
    n, at = len(values), values.offset
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(values: pa.Array, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets from 0) of runs of whole rows with about `limit` bytes."""
    data, offsets = columns(values)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of some rows: starts, ends (bytes), hashes, and first[i]:first[i+1] of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED):
        n = len(data)
        self.data, self.offsets = data, offsets
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first, self.hashes = np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
            return
        value = table[data]
        inside = value != 0
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        up, down = powers(n)
        value *= up[:n]
        self.hashes = mix(np.add.reduceat(value, self.starts) * down[self.starts]) if len(self.starts) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return bytes(self.data[self.starts[i] : self.ends[i]])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers inside (0, 1)."""
    return ((h >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i, in double precision and the order given."""
    out = np.zeros(len(first) - 1, np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values.astype(np.float64), first[:-1][full])
    return out
