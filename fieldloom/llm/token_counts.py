"""Token counts by rank-synchronous merging of ragged arrays.

Distinct pre-tokens of a batch are one flat array of symbol ids and an array of lengths. Each round finds, for every
pre-token at once, the adjacent pair of lowest rank (a segmented minimum) and merges all its places; a pre-token with no
mergeable pair leaves the batch, and the number of symbols that it has left is its token count. Ranks come from a sorted
array of the vocabulary's pairs. Texts are cut at special tokens, then into chunks whose counts a bounded cache holds.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.llm.text_kernel import relieved, slices, utf8
from fieldloom.llm.vocab import BATCH_BYTES, ChunkCache, byte_alphabet, default_path, load, one_word, segment_sums

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_NEVER = np.int64(1) << 40


class Merger:
    """The merge table of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.symbol = np.array([vocab[x] for x in byte_alphabet()], np.int64)
        self.byte = {x: k for k, x in enumerate(byte_alphabet())}
        self.pre = load(path).pre_tokenizer

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER)

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence once no pair of it can be merged."""
        out = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        symbols, lengths = symbols[np.repeat(lengths > 1, lengths)], lengths[live]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), _NEVER)  # of the pair that begins at each symbol
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(live):
            first = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, first)
            done = lowest == _NEVER
            if done.any():
                out[live[done]] = lengths[done]
                keep = np.repeat(~done, lengths)
                symbols, rank, live, lengths, lowest = symbols[keep], rank[keep], live[~done], lengths[~done], lowest[~done]
                if not len(live):
                    break
            owner = np.repeat(np.arange(len(lengths)), lengths)
            run = np.flatnonzero(rank == lowest[owner])
            # of overlapping places (a run of one symbol) every other one counts, from the left
            begins = np.flatnonzero(np.diff(run, prepend=-2) != 1)
            place = np.arange(len(run)) - np.repeat(begins, np.diff(begins, append=len(run)))
            run = run[place % 2 == 0]
            symbols[run] = self.merged[rank[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            lengths = lengths - np.bincount(owner[run], minlength=len(lengths))
            now = (np.cumsum(keep) - 1)[run]
            symbols, rank, owner = symbols[keep], rank[keep], owner[keep]
            near = np.concatenate([now, now[now > 0] - 1])
            rank[near] = _NEVER
            near = near[near + 1 < len(symbols)]
            near = near[owner[near] == owner[near + 1]]
            rank[near] = self.ranks(symbols[near], symbols[near + 1])
        return out

    def counts(self, chunks: list[bytes]) -> list[int]:
        """Tokens of each chunk."""
        split = [(x,) if one_word(x) else tuple(bytes(map(self.byte.__getitem__, s)) for s, _ in self.pre.pre_tokenize_str(x.decode())) for x in chunks]
        words = list(dict.fromkeys(w for x in split for w in x))
        if not words:
            return [0] * len(chunks)
        left = self.survivors(self.symbol[np.frombuffer(b"".join(words), np.uint8)], np.fromiter(map(len, words), np.int64, len(words)))
        found = dict(zip(words, left.tolist(), strict=True))
        return [found[x[0]] if len(x) == 1 else sum(map(found.__getitem__, x)) for x in split]


@lru_cache(maxsize=2)
def counter(path: str) -> ChunkCache:
    return ChunkCache(path, Merger(path).counts, lambda _: 1)


def count(raw: np.ndarray, offsets: np.ndarray, cache: ChunkCache) -> np.ndarray:
    """Tokens of each text of a buffer."""
    out = [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets, BATCH_BYTES):
        values, index, first = cache.look_up(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        out.append(segment_sums(np.array(values, np.int64)[index], first))
    return np.concatenate(out)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row of ``docs(doc_id, text)``, of the whole text."""
    path = path or default_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = counter(path)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            tokens = count(raw, offsets, cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )
        cache.shrink()

    return docs.select("doc_id", "text").mapInArrow(relieved(run), SCHEMA)
