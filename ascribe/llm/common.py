"""Array helpers for Arrow batches of texts: word spans and 64-bit hashes.

Everything here works on one bounded slice of rows inside a Spark task.  A
word is a run of bytes outside 0x20 and 0x09-0x0D; in UTF-8 these bytes occur
only as themselves, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20          # text bytes handled at once; a longer text makes a slice of its own

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE_2 = int(_rng.integers(1 << 62, 1 << 63, dtype=np.uint64)) * 2 + 1
_LANES = ((_BYTE, _BASE, _INVERSE), (_BYTE_2, _BASE_2, pow(_BASE_2, -1, 1 << 64)))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; a slice's worth is kept for
    the next slice, those of a longer text are not."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(SLICE_BYTES + 1, n)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(got, dtype=np.uint64, out=got)
        if size == SLICE_BYTES + 1:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """Order-sensitive 64-bit name of the pair (x, y)."""
    with np.errstate(over="ignore"):
        return mix(mix(x + np.uint64(salt)) * np.uint64(3) + y)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_BYTES of text, or one longer row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Word spans of a slice: ``start``/``end`` byte offsets, and ``first[i]``
    to ``first[i + 1]`` the words of row ``i``.  Null texts have none."""

    def __init__(self, texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.row = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        if len(data):
            gap = separator[data]
            left, right = np.empty(len(data), bool), np.empty(len(data), bool)
            left[0], right[-1] = True, True
            left[1:], right[:-1] = gap[:-1], gap[1:]
            inner = self.row[(self.row > 0) & (self.row < len(data))]
            left[inner], right[inner - 1] = True, True
            self.start = np.flatnonzero(left & ~gap)
            self.end = np.flatnonzero(right & ~gap) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.row)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes; lane 1 gives a second, independent one."""
        byte, base, inverse = _LANES[lane]
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.take(byte, self.data, out=sums[1:])
            sums[1:] *= powers(base, n)
            np.cumsum(sums[1:], out=sums[1:])
            value = (sums[self.end] - sums[self.start]) * powers(inverse, n)[self.start]
            return mix(value + (self.end - self.start).astype(np.uint64))

    def text(self, row: int, keep: np.ndarray | None = None) -> bytes:
        """The row's words (those marked in ``keep``), joined by one space."""
        a, b = self.first[row], self.first[row + 1]
        raw = self.data.tobytes() if len(self.count) == 1 else self.data[self.row[row]:self.row[row + 1]].tobytes()
        at = self.row[row]
        return b" ".join(raw[s - at:e - at] for k, (s, e) in enumerate(zip(self.start[a:b].tolist(), self.end[a:b].tolist()))
                         if keep is None or keep[k])


def windows(values: np.ndarray, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie in one row, and each one's row."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = values[:n]
    for i in range(1, k):
        out = combine(out, values[i:n + i], i)
    doc = words.doc
    whole = doc[:n] == doc[k - 1:]
    return out[whole], doc[:n][whole]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits (Spark's bigint)."""
    return np.ascontiguousarray(x).view(np.int64)
