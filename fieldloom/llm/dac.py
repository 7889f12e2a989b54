"""Token-id files of directly addressable codes.

A shard holds the ids of whole documents in ascending doc_id order. Each id is split into 8-bit chunks, least significant
first. Level k has the k-th chunk of every id that has one, a bitmap that says which of them continue on the next level,
and a rank directory (the number of set bits before each block of 512). Any id is read with one probe a level: its place
on the next level is the rank of its bit, so no block is decoded. Files are Parquet tables with a shard in each row, so
they can be in any store that Spark reaches, and a lost executor costs only the shards it was writing.

Layout of a shard, little-endian: ``FORMAT``; number of documents, ids and levels (3 uint64); doc_ids (int64, the least
for null); ids of each document (uint64); then for each level the number of chunks (uint64), the bitmap (padded to whole
blocks of 64 bytes), the directory (uint64 a block, and the total), and the chunks.

Defined results: a null or empty text is the end id alone; rows with one doc_id are kept, in order of their texts; a null
doc_id comes first; an empty table gives no shard.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import Workspace
from fieldloom.llm.text_kernel import relieved, slices, utf8
from fieldloom.llm.vocab import BATCH_BYTES, ChunkCache, byte_alphabet, default_path, load, one_word, segment_sums

FORMAT = b"DACSHRD1"
BLOCK = 512
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Ids after which a shard is closed at the end of a document.
SHARD_IDS = 2_000_000
_NULL = np.iinfo(np.int64).min
SHARD_SCHEMA = "part int, shard int, n_docs long, n_ids long, payload binary"
DOC_SCHEMA = "part int, shard int, doc_id long, place int, offset long, n_tokens long, ids_crc32 long"
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    parts, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        blocks = -(-len(rest) // BLOCK)
        bitmap = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        directory = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BITS[bitmap].reshape(blocks, BLOCK // 8).sum(1, dtype=np.uint64), dtype=np.uint64)])
        parts += [np.uint64(len(rest)).tobytes(), bitmap.tobytes(), directory.tobytes(), (rest & 0xFF).astype(np.uint8).tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    head = np.array([len(doc_ids), len(ids), len(parts) // 4], np.uint64)
    return b"".join([FORMAT, head.tobytes(), doc_ids.astype(np.int64).tobytes(), lengths.astype(np.uint64).tobytes(), *parts])


class Shard:
    """A shard's bytes, read in place."""

    def __init__(self, payload: bytes):
        if payload[: len(FORMAT)] != FORMAT:
            raise ValueError("not a shard of directly addressable codes")
        self.payload, self.at = payload, len(FORMAT)
        n_docs, self.n_ids, n_levels = map(int, self._take(np.uint64, 3))
        self.doc_ids, self.lengths = self._take(np.int64, n_docs), self._take(np.uint64, n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take(np.uint64, 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((self._take(np.uint8, blocks * BLOCK // 8), self._take(np.uint64, blocks + 1), self._take(np.uint8, n)))

    def _take(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self.payload, kind, n, self.at)
        self.at += out.nbytes
        return out

    def __getitem__(self, i: int) -> int:
        """The i-th id of the shard, by one probe a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for k, (bitmap, directory, chunks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            lo = block * BLOCK // 8
            i = int(directory[block]) + int(_BITS[bitmap[lo : i >> 3]].sum()) + int(_BITS[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
        return out

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        out = np.zeros(0, np.uint32)
        for bitmap, _, chunks in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(out):
                here[np.flatnonzero(np.unpackbits(bitmap, count=len(chunks), bitorder="little"))] |= out << 8
            out = here
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkCache:
    tokenizer = load(path)
    model, alphabet = tokenizer.model, str.maketrans(dict(enumerate(byte_alphabet())))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already

    def encode(chunks: list[bytes]) -> list[bytes]:
        # a word is one piece of the pattern, which the tokenizer's model takes as it is; the rest goes the whole way
        out = [array("I", [t.id for t in model.tokenize(x.decode("latin-1").translate(alphabet))]).tobytes() if one_word(x) else None for x in chunks]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", found.ids).tobytes()
        return out

    return ChunkCache(path, encode, lambda i: np.array([i], "<u4").tobytes())


def encode_texts(raw: np.ndarray, offsets: np.ndarray, cache: ChunkCache, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a buffer, each with the end id, and the number of ids of each."""
    values, index, first = cache.look_up(raw, offsets)
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    begin = np.cumsum(size) - size
    n = size[index]
    lengths = segment_sums(n, first)
    # ids go to their places; the end ids fill the places that stay
    out = np.full(int(lengths.sum()) + len(lengths), end, np.uint32)
    source = np.arange(int(n.sum()), dtype=np.int32) + np.repeat((begin[index] - (np.cumsum(n) - n)).astype(np.int32), n)
    out[np.arange(len(source), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)] = flat[source]
    return out, lengths + 1


def write_shards(docs: DataFrame, path: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of the documents' ids in ascending doc_id order, as rows ``part, shard, n_docs, n_ids, payload``."""
    path = path or default_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([encode_shard(doc_ids, lengths, ids)], pa.binary())],
                ["part", "shard", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            doc_ids = batch.column(0).cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(batch.column(1))
            for lo, hi in slices(offsets, min(BATCH_BYTES, 2 * shard_ids)):
                ids, lengths = encode_texts(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], cache, end)
                held.append((doc_ids[lo:hi], lengths, ids))
                if sum(len(x[2]) for x in held) >= shard_ids:
                    yield close()
                    shard += 1
        if held:
            yield close()
        cache.shrink()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(relieved(run), SHARD_SCHEMA)


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of written shards, from their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ids = shard.ids().astype("<u4", copy=False)
                begin = np.cumsum(shard.lengths) - shard.lengths
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), shard.lengths.tolist(), strict=True)]
                n = len(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int32()),
                        pa.array(np.full(n, batch.column(1)[row].as_py()), pa.int32()),
                        pa.array(shard.doc_ids, mask=shard.doc_ids == _NULL),
                        pa.array(np.arange(n), pa.int32()),
                        pa.array(begin),
                        pa.array(shard.lengths),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "place", "offset", "n_tokens", "ids_crc32"],
                )

    # ids before each part, and before each shard of a part; payloads aren't read for that
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    within = before.partitionBy("part").orderBy("shard")
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    found = shards.select("part", "shard", "payload").mapInArrow(relieved(run), DOC_SCHEMA)
    return found.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the token-id files of ``docs(doc_id, text)`` to the shared folder and reads each document back from them."""
    work = Workspace(docs.sparkSession, "token-ids")
    written = write_shards(docs, path)
    to = f"{work.path}/shards"
    written.write.option("compression", "zstd").parquet(to)
    return read_documents(docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(to))
