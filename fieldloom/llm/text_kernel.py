"""Vectorised UTF-8 kernels that the text operators share.

A batch of texts is one byte buffer and one offsets array, as Arrow holds it. Words, word hashes and word n-gram hashes
are found with numpy over the whole buffer, with no Python work for a word. Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one vectorised step takes (more when one text is longer); bounds the scratch arrays.
SLICE_BYTES = 1_000_000


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def relieve() -> None:
    """Gives the allocators' free pages back; workers live on between tasks, and hold them otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def relieved(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that relieves its worker of free memory when it ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            relieve()

    return wrapped


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each, at least one text."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of a word: all but the given closed ranges."""
    table = np.ones(256, bool)
    for a, b in excluded:
        table[a : b + 1] = False
    return table


#: Letters and digits of ASCII and every byte of a code point beyond it.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Everything but ASCII white space.
NONSPACE = byte_class([(0x09, 0x0D), (0x20, 0x20)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of each word, and the index of each text's first word (with the total at the end)."""
    inside = word[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a public hash)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 256), 0x9E3779B97F4A7C55, U)
        base[0] = 1
        _POWERS = np.cumprod(base, dtype=U)
    return _POWERS[:n]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes with A-Z lowered."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    small = np.int32 if len(raw) < 1 << 31 else np.int64
    place = np.arange(int(lengths.sum()), dtype=small) - np.repeat(first.astype(small), lengths)
    value = LOWER[raw[place + np.repeat(starts.astype(small), lengths)]].astype(U)
    value += U(1)
    value *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(U) * U(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words that begin at each position; the last n-1 positions of the array hold nothing useful."""
    out = np.zeros(len(words), U)
    m = len(words) - n + 1
    if m > 0:
        g = words[:m].copy()
        for j in range(1, n):
            g *= U(0x880355F21E6D1965)
            g += words[j : j + m]
        out[:m] = mix(g + U(n * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
