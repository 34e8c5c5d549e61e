"""Vectorised scans over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x + U64(0x9E3779B97F4A7C15)).astype(U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_CODE = splitmix(np.arange(256, dtype=U64)) | U64(1)
BASE = 0x9E6C63D0876A9A75
BASE_INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept and doubled as texts get longer."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        have = np.ones(size + 1, U64)
        have[1:] = U64(base)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they lie."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, U64)
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * powers(BASE, n)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts]
        return splitmix(h ^ splitmix((ends - starts).astype(U64)))


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` bytes, at every place."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_CODE[data] * powers(BASE, n)[:n], out=sums[1:])
        h = sums[width:] - sums[:-width]
        h *= powers(BASE_INVERSE, n)[: n - width + 1]
    return splitmix(h)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text, at least one row each: memory follows the longest text only."""
    _, offsets = texts_of(batch.column(column))
    start, n = 0, len(batch)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return UPPER[data]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Digits, lower-case letters and all bytes of characters outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte], which never cross texts; and words before each text."""
    n = len(data)
    is_in = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = is_in.copy()
    begins[1:] &= ~is_in[:-1] | first[1:n]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def take_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + count - 1 for each row, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of words[start : start + length] for each start."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(starts), U64)
        for k in range(length):
            h = splitmix(h * U64(3) + words[starts + k])
        return h
