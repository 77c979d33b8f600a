"""Words, hashes and batches of whole texts as numpy arrays, for use inside tasks."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A piece holds about so many bytes of text, whole documents only.
PIECE_BYTES = 1 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*, without: str) -> np.ndarray:
    """Truth per byte: is it part of a word?  ``without`` lists what is not."""
    mask = np.ones(256, dtype=bool)
    mask[list(without.encode())] = False
    return mask


#: Words of ``[^\x20\x09-\x0D]+``.
PLAIN_WORD = byte_class(without=" \t\n\v\f\r")

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, PIECE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
    return known[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.zeros(1, dtype=np.int64)
    if len(column):
        offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents.

    Bounds the arrays made from a batch; a single longer document is a run of its own.
    """
    data, offsets = text_bytes(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words of document i as first[i] .. first[i+1]."""
    mask = inside[data]
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, from one running sum."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64) * _GOLDEN)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; of all words if there are fewer."""
    size = min(size, len(words))
    out = np.full(len(words) - size + 1 if size else 0, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = mix(out * _GOLDEN + words[k : k + len(out)])
    return out


def spark_int64(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed numbers that Spark knows."""
    return x.view(np.int64)


def give_back() -> None:
    """Return freed memory to the machine: Spark keeps idle workers, and they what they have freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)
