"""Words and hashes of many texts at once, found on the UTF-8 bytes of an Arrow column.

Spark hands over Arrow batches; everything here is numpy over the bytes of one slice of a batch, whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A slice holds texts of about this many bytes, or one longer text.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: For bytes.translate: A-Z in lower case, every other byte as it is.
LOWER_BYTES = _LOWER.tobytes()

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_UNMIX_1, _UNMIX_2 = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_MIX_1, _MIX_2))
_powers: dict[str, np.ndarray] = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 1 << 20), _BASE if kind == "base" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _UNMIX_2
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _UNMIX_1
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its texts in them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of bounded text size, so that working memory doesn't follow Arrow's batch size."""
    ends = utf8(batch.column(batch.schema.get_field_index(column)))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    weighted = data.astype(np.uint64)
    weighted += np.uint64(1)
    weighted *= _power("inverse", n)
    np.cumsum(weighted, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power("base", n + 1)[ends])


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every text of a column: ``starts``, ``ends`` (bytes) and ``text`` (its row) of each."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = _LOWER[self.data]
        word = ~_SPACE[self.data]
        first = np.zeros(len(word) + 1, bool)
        first[self.offsets] = True
        if len(word):
            begins = word & (first[:-1] | np.concatenate(([True], ~word[:-1])))
            finish = word & (first[1:] | np.concatenate((~word[1:], [True])))
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.is_word = word
        #: Words before each text; the words of text i are bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, starts, ends)


def windows(values: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` values within one row, and the index of each run's first value."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(row[:n] == row[size - 1 :])
    out = values[whole]
    for k in range(1, size):
        out = mix(out * _BASE + values[whole + k])
    return out, whole


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive ``bounds``."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
