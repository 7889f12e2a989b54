"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: of every ``SPAN - GRAM + 1`` consecutive hashes of ``GRAM`` words the least is kept
(the last of equal ones). Two texts that share ``SPAN`` words then share the fingerprint chosen in that stretch, so every
shared window is found through a join on fingerprints. A hit is extended to the windows of ``SPAN`` words around it, which
count where the whole window occurs in an item. Items of fewer than ``SPAN`` words are one window of their own length,
fingerprinted by that window's hash.

Two plans give the same rows. While the benchmark's windows are counted and few (``BROADCAST_WINDOWS``), its sorted
hashes go to every task and documents aren't shuffled. Beyond, the winnowed fingerprints of the documents pass a bitmap of
the benchmark's, those that do are joined with it, and only they meet the windows of the items they may hold.

Defined results: null, empty or wordless texts have no words and no hit, and such items no window; documents that repeat
are reported as often; items that repeat an id are one item; items without an id are together one item that hits words and
counts in ``n_items`` but has no name in ``items_sha256``; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Workspace, bitmap, in_bitmap
from fieldloom.llm.text_kernel import ALNUM, mix, ngram_hashes, relieved, signed, slices, utf8, word_hashes, word_spans

SPAN = 10
GRAM = 6
#: Benchmark windows (some 200 bytes each, with their items) that are sent to every task; beyond, fingerprints are joined.
BROADCAST_WINDOWS = 200_000
WINDOW_SCHEMA = "item_id string, length int, window long, print long"
DOC_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least of every ``width`` consecutive values, the last of equal ones; ascending and distinct."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = grams[j : j + n]
        better = other <= best
        best = np.where(better, other, best)
        at = np.where(better, np.arange(j, j + n), at)
    return np.unique(at)


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: their word hashes and the index of each row's first word."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo], ALNUM)
        yield lo, hi, word_hashes(part, starts, ends), first


def _prints(grams: np.ndarray) -> np.ndarray:
    """An order of the hashes that doesn't follow their use elsewhere."""
    return mix(grams ^ np.uint64(0x5851F42D4C957F2D))


def benchmark_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every distinct window of each item: its length in words, its hash, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, words, first in _words(batch.column(1)):
                rows: list[tuple[str, int, int, int]] = []
                for k in range(lo, hi):
                    own = words[first[k - lo] : first[k - lo + 1]]
                    if not len(own):
                        continue
                    length = min(span, len(own))
                    window = ngram_hashes(own, length)[: len(own) - length + 1]
                    if length < span:
                        chosen = window
                    else:
                        prints = _prints(ngram_hashes(own, gram)[: len(own) - gram + 1])
                        chosen = np.array([prints[p : p + span - gram + 1].min() for p in range(len(window))], np.uint64)
                    rows += [(names[k], length, int(a), int(b)) for a, b in zip(signed(window), signed(chosen), strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item_id", "length", "window", "print"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(relieved(run), WINDOW_SCHEMA).distinct()


@dataclass
class WindowIndex:
    """Sorted hashes of the benchmark's windows by their length, and the items of each."""

    span: int
    gram: int
    prints: np.ndarray
    windows: dict[int, np.ndarray]
    items: dict[int, dict[int, tuple[str | None, ...]]]

    @classmethod
    def of(cls, rows: list[tuple[str, int, int, int]], span: int, gram: int) -> WindowIndex:
        items: dict[int, dict[int, list[str]]] = {}
        for name, length, window, _ in rows:
            items.setdefault(length, {}).setdefault(window, []).append(name)
        prints = np.unique(np.array([p for _, length, _, p in rows if length == span], np.int64))
        windows = {length: np.array(sorted(x), np.int64) for length, x in items.items()}
        return cls(span, gram, prints, windows, {k: {w: tuple(set(n)) for w, n in x.items()} for k, x in items.items()})


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def _fits(first: np.ndarray, n: int) -> np.ndarray:
    """Words of the own text from each position on."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(n)


def _doc_prints(words: np.ndarray, rest: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed positions in a buffer of texts, and the fingerprints there."""
    prints = _prints(ngram_hashes(words, gram))
    # a stretch across two texts chooses positions too; they are kept only as far as the gram lies in one text
    prints[rest < gram] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = winnow(prints, span - gram + 1)
    at = at[rest[at] >= gram]
    return at, signed(prints)[at]


def find(words: np.ndarray, first: np.ndarray, index: WindowIndex) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Which words of a buffer of texts are hit, and the positions and lengths of the windows that hit them."""
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    rest = _fits(first, n)
    places: list[tuple[np.ndarray, int]] = []
    for length, windows in index.windows.items():
        if length == index.span:
            at, prints = _doc_prints(words, rest, index.span, index.gram)
            at = at[_among(prints, index.prints)]
            # extend each hit to the windows that hold its gram
            at = np.unique((at[:, None] - np.arange(index.span - index.gram + 1)[None, :]).ravel())
            at = at[at >= 0]
        else:
            at = np.arange(n)
        at = at[rest[at] >= length]
        if not len(at):
            continue
        hashes = signed(ngram_hashes(words, length))[at]
        at = at[_among(hashes, windows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + length, -1)
        places.append((at, length))
    return np.cumsum(hit[:n]) > 0, places


def digest(names: set[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest()


_CLEAN = digest(set())


def _report(batch: pa.RecordBatch, index: WindowIndex) -> pa.RecordBatch:
    n_words, n_hit, n_items, sha = [], [], [], []
    for lo, hi, words, first in _words(batch.column(1)):
        hit, places = find(words, first, index)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
        names: dict[int, set[str]] = {}
        for at, length in places:
            owner = np.searchsorted(first, at, "right") - 1
            hashes = signed(ngram_hashes(words, length))[at]
            for k, h in zip(owner.tolist(), hashes.tolist(), strict=True):
                names.setdefault(k, set()).update(index.items[length][h])
        n_words += np.diff(first).tolist()
        n_hit += (total[first[1:]] - total[first[:-1]]).tolist()
        n_items += [len(names.get(k, ())) for k in range(hi - lo)]
        sha += [digest(names[k]) if k in names else _CLEAN for k in range(hi - lo)]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: its words, those inside an item's window, and the items it holds."""
    windows = Workspace(docs.sparkSession, "winnowing").keep(benchmark_windows(items, span, gram), "windows")
    if windows.count() > broadcast_windows:
        return _by_join(docs, windows, span, gram)
    held = docs.sparkSession.sparkContext.broadcast(WindowIndex.of([tuple(r) for r in windows.collect()], span, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _report(batch, held.value)

    return docs.select("doc_id", "text").mapInArrow(relieved(run), DOC_SCHEMA)


def _by_join(docs: DataFrame, windows: DataFrame, span: int, gram: int) -> DataFrame:
    """The plan for a benchmark of any size.

    Each document goes through once for its fingerprints. Those that meet a fingerprint of the benchmark come back as
    candidate windows (the hash of each window around the hit), which are joined with the benchmark's windows.
    """
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # span of them at most
    held = docs.sparkSession.sparkContext.broadcast({n: bitmap(windows.where(F.col("length") == n).select("print").distinct(), "print") for n in lengths})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, words, first in _words(batch.column(1)):
                rest = _fits(first, len(words))
                for length in lengths:
                    if length == span:
                        at, prints = _doc_prints(words, rest, span, gram)
                        known = in_bitmap(prints, held.value[length])
                        at, prints = at[known], prints[known]
                        around = at[:, None] - np.arange(span - gram + 1)[None, :]
                        prints, at = np.broadcast_to(prints[:, None], around.shape).ravel(), around.ravel()
                        ok = (at >= 0) & (rest[np.maximum(at, 0)] >= length)
                        at, prints = at[ok], prints[ok]
                        hashes = signed(ngram_hashes(words, length))[at]
                    else:
                        at = np.flatnonzero(rest >= length)
                        prints = signed(ngram_hashes(words, length))[at]
                        known = in_bitmap(prints, held.value[length])
                        at, hashes = at[known], prints[known]
                        prints = hashes
                    owner = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi][owner]), pa.array(at - first[owner]), pa.array(np.full(len(at), length), pa.int32()), pa.array(hashes), pa.array(prints)], ["row", "at", "length", "window", "print"]
                    )

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [x for *_, first in _words(batch.column(2)) for x in np.diff(first).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(n, pa.int64())], ["row", "doc_id", "n_words"])

    numbered = Workspace(docs.sparkSession, "winnowing").keep(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "docs")
    found = numbered.select("row", "text").mapInArrow(relieved(candidates), "row long, at long, length int, window long, print long")
    # the fingerprint join first: both sides carry it, and a row that fails it never meets a window
    met = found.join(windows.select("length", "print").distinct(), ["length", "print"], "left_semi").select("row", "at", "length", "window").distinct()
    met = met.join(windows.select("item_id", "length", "window"), ["length", "window"])
    hits = met.select("row", "item_id", F.explode(F.sequence("at", F.col("at") + F.col("length") - 1)).alias("word"))
    per = hits.groupBy("row").agg(F.countDistinct("word").alias("n_hit"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("names"), (F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).alias("n_items"))
    return (
        numbered.mapInArrow(relieved(totals), "row long, doc_id long, n_words long")
        .join(per, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
