"""Words, word hashes and word windows of whole string columns, in numpy.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Nulls are
empty texts. Texts are worked on in slices of bounded size; a longer text is a slice of its
own and is hashed in pieces, so the work space is a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
#: Longest byte range that is hashed by a polynomial.
SHORT_SPAN = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _powers(inverse: bool, length: int) -> np.ndarray:
    base = int(_BASE)
    if inverse:
        base = pow(base, -1, 1 << 64)
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(inverse: bool, length: int) -> np.ndarray:
    """Powers of the base, kept in lengths of powers of two."""
    return _powers(inverse, max(SLICE_BYTES, 1 << int(length).bit_length()))[:length]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that do not overlap and are in order.

    Short ranges are polynomials modulo 2 ** 64, taken from running sums. Some patterns of 1,024
    bytes and more have equal values under any such polynomial, so ranges of more than
    ``SHORT_SPAN`` bytes get a digest of their own.
    """
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + SLICE_BYTES, side="right")))
        piece = data[low : int(ends[last - 1])]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _power(False, len(piece)), out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        h = (sums[b] - sums[a]) * _power(True, len(piece) + 1)[a]
        out[first:last] = mixed(h + (b - a).astype(np.uint64))
        first = last
    for k in np.flatnonzero(ends - starts > SHORT_SPAN).tolist():
        digest = blake2b(data[int(starts[k]) : int(ends[k])].tobytes(), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


@dataclass
class Words:
    """The words of some texts. ``edges`` has the byte offset of each text, and the end."""

    data: np.ndarray
    edges: np.ndarray

    @cached_property
    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        word = np.zeros(len(self.data) + 2, np.int8)
        word[1:-1] = ~space
        step = np.diff(word)
        inner = self.edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.data))]
        cut = np.unique(inner[(word[inner] == 1) & (word[inner + 1] == 1)])
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(cut):  # one text ends and the next begins within a run of bytes
            starts, ends = np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
        return starts, ends

    @property
    def starts(self) -> np.ndarray:
        return self._bounds[0]

    @property
    def ends(self) -> np.ndarray:
        return self._bounds[1]

    @property
    def texts(self) -> int:
        return len(self.edges) - 1

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words."""
        return np.searchsorted(self.starts, self.edges)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def text_of(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(self.texts), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    @cached_property
    def lower_hashes(self) -> np.ndarray:
        """Hashes after A-Z became a-z."""
        return span_hashes(_LOWER[self.data], self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every window of ``size`` words in one text."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.text_of[:n] == self.text_of[size - 1 :])
        h = np.full(len(at), size, np.uint64)
        for i in range(size):
            h = h * _WINDOW + hashes[at + i]
        return at, mixed(h)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[self.edges])

    def word_sums(self, marks: np.ndarray) -> np.ndarray:
        """Number (or sum) of the marks of each text's words."""
        return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[self.first])


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in runs of rows whose texts are about SLICE_BYTES together, with their words."""
    data, edges = buffer_of(batch.column(column))
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + SLICE_BYTES, side="right")) - 1)
        stop = min(stop, row + 8192, batch.num_rows)
        yield batch.slice(row, stop - row), Words(data[edges[row] : edges[stop]], edges[row : stop + 1] - edges[row])
        row = stop
