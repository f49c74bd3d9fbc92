"""Words, shingles and hashes of texts as NumPy arrays, a slice of an Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)


@lru_cache(maxsize=4)
def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Prefix:
    """Hashes of any stretches of a sequence of 64-bit codes, from a running sum of it.

    Different stretches may share a hash (those of Thue-Morse strings do), so these hashes only route and sample; what is
    called equal is compared by its bytes or by a cryptographic digest of them.
    """

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, codes: np.ndarray):
        size = 1 << max(10, int(len(codes)).bit_length())
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(size, self.BASE)[: len(codes)], out=self.sums[1:])
        self.inverse = powers(size, pow(self.BASE, -1, 1 << 64))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * ODD)


def slices(batch: pa.RecordBatch, text: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of runs of rows with about `limit` bytes of text; a null text is empty."""
    column = batch.column(text)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte places of all words in order, and of each document its first word, with a last entry for their end.

    between: of each byte value whether it lies between words.
    """
    cut = between[data]
    start = ~cut
    end = start.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start[1:] &= cut[:-1] | edge[1:-1]
    end[:-1] &= cut[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number of the eight bytes from each place on, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer stretches are hashed and compared one by one.
SHORT = 64


def codes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes: eight bytes a step through a scrambling that is not linear, BLAKE2b for long ones."""
    size = end - start
    code = mix(size.astype(np.uint64) * ODD)
    view, live = eights(data), np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        code[live] = mix((code[live] ^ (view[start[live] + at] & LOW[np.minimum(size[live] - at, 8)])) * ODD)
    for i in np.flatnonzero(size > SHORT).tolist():
        code[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return code


def same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes from a[i] on equal those from b[i] on, byte for byte."""
    out = np.ones(len(a), bool)
    view, live = eights(data), np.flatnonzero(size <= SHORT)
    for at in range(0, SHORT, 8):
        live = live[(size[live] > at) & out[live]]
        if not len(live):
            break
        mask = LOW[np.minimum(size[live] - at, 8)]
        out[live] = (view[a[live] + at] & mask) == (view[b[live] + at] & mask)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = bool((data[a[i] : a[i] + size[i]] == data[b[i] : b[i] + size[i]]).all())
    return out


def joined(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` codes from each place on, in their order."""
    out = np.full(len(at), size, np.uint64) * ODD
    for k in range(size):
        out = mix((out ^ codes[at + k]) * ODD)
    return out


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): a 64-bit hash of each word, and of each document its first word, with a last entry."""
    start, end, first = words(data, offsets)
    return codes_of(data, start, end), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Of each document its distinct shingles of `size` words as sorted 64-bit hashes.

    A text of fewer words has one shingle, all its words; a text without a word has none.
    """
    codes, first = word_codes(data, offsets)
    whole = joined(codes, np.arange(max(0, len(codes) - size + 1)), size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, np.uint64)
        elif b - a < size:
            yield joined(codes, np.array([a]), b - a)
        else:
            yield np.unique(whole[a : b - size + 1])
