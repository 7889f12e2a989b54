"""Language identification by cross-parsing entropy.

A bounded sample of labelled text of each language is indexed by a suffix automaton. A text is cut into the longest
phrases that occur in a language's sample (greedily, from left to right, over the whole text); with c phrases over n
symbols and a sample of m symbols, ``c log2(m) / n`` estimates the cross entropy, and the language that needs fewest
normalised phrases wins.

Texts are lower-cased; every run of other characters than letters is one space. Each letter of the samples has its own
symbols: the most frequent ``LETTERS`` one each, the others a code of several. The texts of a batch step through the
automata's transition tables together, the long ones first; the last few are finished one by one.

The sample is drawn over distinct texts, so copies neither crowd it nor leave it empty: of each language the texts with
the least hashes, of each a stretch that begins at a place given by the hash. With many languages each gets less, so that
all together stay within ``SAMPLE_TOTAL`` symbols; no language is left out.

Defined results: ``und`` with score 0 for a null or empty text, one without letters, or when nothing was learned; ties go
to the first language by name; repeated rows repeat; rows with null text or lang, or null doc_id, aren't learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import Workspace, local_table
from fieldloom.llm.text_kernel import relieved, slices, utf8

#: Bounds of the sample that the classifier is fitted on: texts a language and in all, characters of each text, symbols a
#: language and in all.
SAMPLE_ROWS = 150
SAMPLE_ROWS_TOTAL = 20_000
SAMPLE_CHARS = 1_500
SAMPLE_SYMBOLS = 40_000
SAMPLE_TOTAL = 400_000
#: Letters that have one symbol each, the most frequent of the samples; of the others' codes, the values of a place.
LETTERS = 200
DIGITS = 16
#: Texts that step together, a new one in the place of each that ends; the last few are finished one by one.
LANES, TOGETHER = 512, 16
#: Bytes of text that are parsed at a time.
BATCH_CHARS = 2_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case letter of every code point that is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def normalise(text: str) -> str:
    """Lower-case letters with one space for each run of other characters."""
    return "".join(map(chr, _normal(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))))


def _normal(codes: np.ndarray) -> np.ndarray:
    low = _letters()[codes]
    low[low == 0] = 0x20
    return low[_kept(low == 0x20)]


def _kept(space: np.ndarray) -> np.ndarray:
    return ~(space & np.concatenate([[False], space[:-1]])) if len(space) else space


class Automaton:
    """A suffix automaton: the smallest machine that accepts every substring of a sequence of symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in symbols:
            current = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = current
                p = link[p]
            if p >= 0:
                q = self.next[p][s]
                if length[q] == length[p] + 1:
                    link[current] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current

    def table(self, n_symbols: int) -> np.ndarray:
        """Transitions as rows of states; 0 for none, as no transition leads to the root."""
        out = np.zeros((len(self.next), n_symbols), np.int32)
        state = np.repeat(np.arange(len(self.next)), [len(x) for x in self.next])
        symbol = np.fromiter((s for x in self.next for s in x), np.int64, len(state))
        out[state, symbol] = np.fromiter((t for x in self.next for t in x.values()), np.int32, len(state))
        return out


class Classifier:
    def __init__(self, samples: dict[str, str]):
        """``samples``: normalised text of each language."""
        self.names = sorted(k for k, x in samples.items() if x.strip())
        frequent = Counter(c for k in self.names for c in samples[k] if c != " ").most_common()
        letters = [ord(c) for c, _ in sorted(frequent, key=lambda x: (-x[1], x[0]))]
        own, rare = letters[:LETTERS], letters[LETTERS:]
        self.symbol = np.zeros(0x110000, np.uint8)  # 0: matches nowhere
        self.symbol[0x20] = 1
        self.symbol[own] = np.arange(2, len(own) + 2)
        self.base, self.digits = len(own) + 2, 0
        self.width = self.base
        if rare:  # a first digit has other symbols than those after it, so a code never begins within another
            self.digits, self.width = 1, self.base + 2 * DIGITS
            while DIGITS**self.digits < len(rare):
                self.digits += 1
            self.order = np.full(0x110000, -1, np.int32)
            self.order[rare] = np.arange(len(rare))
        tables, self.begin, self.bits = [], [], []
        for name in self.names:
            codes = np.frombuffer(samples[name].encode("utf-32-le"), np.uint32)
            symbols, _ = self.symbols(codes, np.array([0, len(codes)]))
            tables.append(Automaton(symbols.tolist()).table(self.width))
            tables[-1][:, 0] = 0
            self.begin.append(sum(len(t) for t in tables[:-1]))
            self.bits.append(math.log2(max(2, len(symbols))))
        # one table for all languages; targets stay relative to the language's root
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.root = np.array(self.begin, np.int64) * self.width

    def symbols(self, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of lower-case letters and spaces, and the offsets among them."""
        out = self.symbol[codes]
        if not self.digits:
            return out, offsets
        order = self.order[codes]
        rare = order >= 0
        size = np.where(rare, self.digits, 1)
        begin = np.concatenate([[0], np.cumsum(size)])
        out, at, number = np.repeat(out, size), begin[:-1][rare], order[rare]
        for j in range(self.digits):
            out[at + j] = self.base + number // DIGITS ** (self.digits - 1 - j) % DIGITS + (DIGITS if j else 0)
        return out, begin[offsets]

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text needs in each language: an array of texts by languages."""
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.names)), np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[: int((size > 0).sum())]
        root, following = self.root[:, None], min(LANES, len(order))
        text = order[:following]
        at, end = offsets[text], offsets[text + 1]
        state, count = (np.zeros((len(self.names), following), np.int64) for _ in range(2))
        while len(text) > TOGETHER or (following < len(order) and len(text)):
            for _ in range(int((end - at).min())):
                symbol = symbols[at].astype(np.int64)[None, :]
                to = self.table[root + state * self.width + symbol]
                miss = to == 0
                count += miss
                state = np.where(miss, self.table[root + symbol], to).astype(np.int64)
                at = at + 1
            done = at == end
            out[text[done]] = count[:, done].T + 1
            fresh = order[following : following + int(done.sum())]
            following += len(fresh)
            free = np.flatnonzero(done)
            text[free[: len(fresh)]] = fresh
            at[free[: len(fresh)]], end[free[: len(fresh)]] = offsets[fresh], offsets[fresh + 1]
            state[:, free], count[:, free] = 0, 0
            if len(fresh) < len(free):
                keep = np.ones(len(text), bool)
                keep[free[len(fresh) :]] = False
                text, at, end, state, count = text[keep], at[keep], end[keep], state[:, keep], count[:, keep]
        table, width = memoryview(self.table), self.width
        for k in range(len(text)):
            rest = symbols[at[k] : end[k]].tobytes()
            for j, first in enumerate(self.root.tolist()):
                now, found = int(state[j, k]), 1 + int(count[j, k])
                for s in rest:
                    to = table[first + now * width + s]
                    if not to:
                        found += 1
                        to = table[first + s]
                    now = to
                out[text[k], j] = found
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        codes = np.frombuffer("".join(f" {x} " for x in texts).encode("utf-32-le", "replace"), np.uint32)  # words have edges
        offsets = np.concatenate([[0], np.cumsum([len(x) + 2 for x in texts])]).astype(np.int64)
        low = _letters()[codes]
        known = np.maximum.reduceat(low, offsets[:-1]) > 0  # no text is empty, its edges included
        if not self.names or not known.any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        low[low == 0] = 0x20
        keep = _kept(low == 0x20)
        keep[offsets[:-1]] = True  # whatever text stands before
        kept = np.add.reduceat(keep, offsets[:-1], dtype=np.int64)
        symbols, offsets = self.symbols(low[keep], np.concatenate([[0], np.cumsum(kept)]))
        del low, keep, codes
        cost = self.phrases(symbols, offsets) * np.array(self.bits) / np.maximum(1, np.diff(offsets))[:, None]
        best = cost.argmin(1)
        low_cost = cost.min(1)
        cost[np.arange(len(best)), best] = np.inf
        second = cost.min(1)
        score = np.where(np.isinf(second), 1.0, 1 - low_cost / np.maximum(second, 1e-12))
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, np.clip(score, 0, 1), 0.0).tolist()


def held_out() -> Column:
    return F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2")


def training_samples(docs: DataFrame, learn: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Normalised text of a bounded sample of the distinct labelled texts of each language, picked by a hash of the text."""
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "language-sample")
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text", F.xxhash64("text").alias("place"))
    texts = work.keep(labelled.select("lang", "place").distinct(), "texts")
    languages = texts.select("lang").distinct().count()
    if not languages:
        return {}
    rows = max(1, min(rows, SAMPLE_ROWS_TOTAL // languages))
    symbols = max(200, min(SAMPLE_SYMBOLS, SAMPLE_TOTAL // languages))
    least = texts.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("nth") <= rows).select("lang", "place")
    picked = local_table(spark, [tuple(r) for r in least.collect()], "lang string, place long")  # rows * languages at most
    begin = F.pmod("place", F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    stretch = labelled.join(F.broadcast(picked), ["lang", "place"]).groupBy("lang", "place").agg(F.min(F.substring("text", begin, F.lit(chars))).alias("text"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in stretch.toLocalIterator():
        found.setdefault(r["lang"], []).append((r["place"], r["text"]))
    work.drop()
    return {lang: " ".join(normalise(t) for _, t in sorted(x))[:symbols] for lang, x in found.items()}


@lru_cache(maxsize=1)
def _classifier(samples: tuple[tuple[str, str], ...]) -> Classifier:
    return Classifier(dict(samples))


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row, from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))  # SAMPLE_TOTAL characters, or 200 a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _classifier(held.value)
        for batch in batches:
            names, scores = predict_column(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        _classifier.cache_clear()  # building it again takes less than the memory is worth to the next step

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(relieved(run), SCHEMA)


def predict_column(model: Classifier, column: pa.Array) -> tuple[list[str], list[float]]:
    """Predictions of a column, in ranges of rows of about ``BATCH_CHARS`` bytes."""
    names, scores = [], []
    for lo, hi in slices(utf8(column)[1], BATCH_CHARS):
        a, b = model.predict([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
        names += a
        scores += b
    return names, scores


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts every row of ``docs(doc_id, text, lang)``."""
    return identify(docs, training_samples(docs, ~held_out()))
