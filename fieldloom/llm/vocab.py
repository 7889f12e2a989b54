"""Chunks of texts that a byte-level BPE tokenizer never merges across, with a bounded cache of what each one becomes.

The tokenizer's pattern always parts at a single space or line feed between two characters that aren't white space, and
between runs of letters, digits and other signs (but after an apostrophe). Those places are found with numpy over the bytes of a batch; only places
whose neighbours are ASCII or Latin-1 letters are cut, and text that stays uncut is encoded as one longer chunk, so the
result is the library's. Added special tokens are cut out first, as the library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Chunks in each of the two generations of a worker's cache.
CACHE_CHUNKS = 120_000
#: Chunks that a worker keeps from a task to the next.
KEPT_CHUNKS = 60_000
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 3_000_000
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
#: 1 for letters of ASCII, 2 for digits, 3 for its other signs, 0 for what isn't told from a byte.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_TIMES, _OVER = 0x97, 0xB7  # second bytes of the two signs among the Latin-1 letters


#: Whether a chunk is one word, and so one piece of the tokenizer's pattern.
one_word = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[bytes, int]:
    return {t.content.encode(): i for i, t in load(path).get_added_tokens_decoder().items()}


def cuts(raw: np.ndarray, offsets: np.ndarray, special: dict[bytes, int]) -> np.ndarray:
    """Ascending byte positions, 0 and the end included, between which the texts' chunks lie."""
    n = len(raw)
    padded = np.zeros(n + 3, np.uint8)
    padded[2 : n + 2] = raw
    two, one, here, after = padded[:n], padded[1 : n + 1], padded[2 : n + 2], padded[3 : n + 3]
    solid = (_PRINTED[one] | ((one >= 0x80) & (two == 0xC3))) & (_PRINTED[after] | (after == 0xC3))
    cut = np.zeros(n + 1, bool)
    cut[:n] = ((here == 0x20) | (here == 0x0A)) & solid
    feed = np.flatnonzero(cut[:n] & (here == 0x0A))
    # where a run of letters, digits or other signs ends; an apostrophe may belong to the letters after it
    kind = _KIND[here]
    lead = np.flatnonzero((here == 0xC3) & (after != _TIMES) & (after != _OVER))
    lead = lead[lead + 1 < n]
    kind[lead] = kind[lead + 1] = 1
    cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (raw[:-1] != 0x27)
    cut[feed + 1] = True
    cut[offsets] = True
    data = raw.tobytes() if special else b""
    for token in special:
        at = -1
        while (at := data.find(token, at + 1)) >= 0:
            if offsets[np.searchsorted(offsets, at, "right")] < at + len(token):
                continue  # spelled over the end of a text: no token in either
            cut[at + 1 : at + len(token)] = False
            cut[at] = cut[at + len(token)] = True
    return np.flatnonzero(cut)


class ChunkCache:
    """The values of every chunk of many texts, each distinct chunk computed once while it is remembered."""

    def __init__(self, path: str, value: Callable[[list[bytes]], list], special: Callable[[int], object]):
        self.special = special_tokens(path)
        self.fixed = {t: special(i) for t, i in self.special.items()}
        self.value, self.known, self.older = value, {}, {}

    def shrink(self) -> None:
        """Forgets all but the chunks that were met first, among which the frequent ones are; for the end of a task."""
        self.known, self.older = dict(islice(self.known.items(), KEPT_CHUNKS)), {}

    def look_up(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """The values of the distinct chunks, the index of each chunk's value, and of each text's first chunk."""
        at = cuts(raw, offsets, self.special)
        if len(at) < 2:
            return [], np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        encoded = chunks.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        if len(self.known) > CACHE_CHUNKS:  # chunks that were used lately move to the younger generation again
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update(self.fixed)
        missing = [x for x in distinct if x not in known]
        if older:
            known.update((x, older[x]) for x in missing if x in older)
            missing = [x for x in missing if x not in older]
        if missing:
            known.update(zip(missing, self.value(missing), strict=True))
        return list(map(known.__getitem__, distinct)), encoded.indices.to_numpy(zero_copy_only=False), np.searchsorted(at[:-1], offsets)


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between successive entries of ``first`` (0 for an empty stretch)."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
