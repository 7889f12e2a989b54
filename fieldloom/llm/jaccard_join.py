"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence matrix with itself.

Rows are distinct n-gram sets (documents with one set share a row), columns are n-gram hashes of 64 bits.

*Which rows meet.* Sizes fall into classes such that linked sets are in one class or in neighbours; sets meet within these
alone. Columns have one order for all rows: rare ones first, by hash, then the common ones by their count. Two
sets of s and t n-grams that link share at least ``T (s + t) / (1 + T)`` columns, so each has one of the shared columns
among its first ``s - ceil(T s) + 1``. Only these leading columns are joined. Counts of columns come from all documents
(what repeats within a million n-grams of a task is sent and summed); they decide the order alone, so results don't
depend on them, and passages that many documents share stand behind each document's own words and bring no pairs.

*Which pairs are multiplied.* The members of a column are first paired with the column's least row only. Linked rows form
components. A column whose members are then still in several components is multiplied in tiles, across components.
Everywhere a histogram bound (the L1 distance of column counts is at most the sets' difference) discards pairs first. What
is left is multiplied in tiles of pairs, column block by column block: overlaps of all pairs of a tile are accumulated at
once, and a pair leaves the tile as soon as its size-derived bound can't be reached. All pairs that could link two
components are thus multiplied, and no others.

*Skew.* Each task joins the equal columns that it holds to stars before the shuffle, so a column sends one row a task, and
the shuffle has so many buckets that a task's share is bounded. In the tiles a component's rows go to one tile each; only
rows outside the group's largest component visit the group's other tiles. Nothing is capped.

Defined results: null, empty or wordless texts have the empty set and link with nothing; repeated rows and equal sets
link; a document with fewer words than n has its whole sequence as one n-gram; empty tables give empty results; a null
doc_id takes part and never is the least of its component (a component without ids has a null ``component_id``).
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.shared import BROADCAST_KEYS, Workspace
from fieldloom.llm.text_kernel import NONSPACE, mix, ngram_hashes, relieved, signed, slices, utf8, word_hashes, word_spans

U = np.uint64
#: Leading columns that a task gathers before it joins equal ones and sends the rest; n-grams whose repeats it counts.
FLUSH = 1_000_000
#: Leading columns that meet in one task, about.
MEET = 4_000_000
TILE = 1_024
#: Repeats from which a column counts as common, and the columns (8 bytes each) that are held as common at most: the most
#: frequent ones. Both only move columns in the order.
COMMON = 16
COMMON_COLUMNS = 1 << 20
#: Slots of the filter in front of the common columns.
COMMON_SLOTS = 1 << 22
#: Columns of the histogram that bounds a difference from below; counts stay in a byte.
BINS = 256
#: Visiting rows of a tile, and pairs, whose bounds are looked at together.
VISIT, TOGETHER = 256, 1 << 13
#: A product's tile: pairs, n-grams, and the column blocks it is accumulated over (a power of two).
PAIRS = 1 << 12
ENTRIES = 1 << 20
BLOCK_BITS = 2


def _int(x: int) -> np.uint64:
    return U(x & 0xFFFFFFFFFFFFFFFF)


@dataclass
class Plan:
    """Sizes and bounds for the threshold ``num / den``.

    Sizes fall into classes such that sets that link are in one class or in neighbours.
    """

    n: int
    num: int
    den: int
    bounds: list[int] = field(default_factory=lambda: [1])

    def bound(self, c: int) -> int:
        """Least size of class c."""
        while len(self.bounds) <= c:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        return self.bounds[c]

    def class_of(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bound(len(self.bounds))
        return bisect_right(self.bounds, size) - 1

    def difference(self, c: int) -> int:
        """Most n-grams in which linked sets differ, the smaller of class c."""
        s = self.bound(c + 1) - 1
        return (s + s * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def roles(self, size: int) -> list[int]:
        """The classes of the smaller set of a link that a set of this size may have; none where only equal sets link."""
        c = self.class_of(size)
        return [r for r in (c, c - 1) if r >= 0 and self.difference(r)]

    def leading(self, s: int) -> int:
        """Columns, first in the order, of which any linked set has one."""
        return s - -(-self.num * s // self.den) + 1

    def least_overlap(self, s, t):
        return -(-self.num * (s + t) // (self.num + self.den))


class Common:
    """The common columns, and the order that they give to the columns of a set."""

    def __init__(self, columns: np.ndarray, times: np.ndarray):
        order = np.argsort(columns)
        self.columns, self.times = columns[order], times[order]
        self.slots = np.zeros(COMMON_SLOTS, bool)
        self.slots[(columns & U(COMMON_SLOTS - 1)).astype(np.int64)] = True

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How often each column was counted; 0 for a rare one."""
        out = np.zeros(len(grams), np.int64)
        if len(self.columns):
            maybe = np.flatnonzero(self.slots[(grams & U(COMMON_SLOTS - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.columns, grams[maybe]), len(self.columns) - 1)
            sure = self.columns[place] == grams[maybe]
            out[maybe[sure]] = self.times[place[sure]]
        return out


def leading(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of the ascending ``grams``: rare ones by hash, then common ones by count and hash."""
    if not counts[:k].any():
        return grams[:k]
    return grams[np.argsort(counts, kind="stable")[:k]]


def ngram_sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ascending distinct n-gram hashes of ranges of texts, one after the other, and the edges between the texts."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, first = word_spans(part, offsets[lo : hi + 1] - offsets[lo], NONSPACE)
        words = word_hashes(part, starts, ends)
        grams = ngram_hashes(words, n)
        sets = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                own = np.sort(grams[a : b - n + 1])
                fresh = np.empty(len(own), bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                sets.append(own[fresh])
            else:
                sets.append(ngram_hashes(words[a:b], b - a)[:1] if b > a else words[:0])
        yield np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def set_keys(grams: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for an empty one."""
    size, out = np.diff(edges), np.zeros(len(edges) - 1, np.int64)
    held = size > 0
    if held.any():
        total = np.add.reduceat(mix(grams ^ U(0x2545F4914F6CDD1D)), edges[:-1][held], dtype=U)
        found = signed(mix(total + size[held].astype(U) * U(0x9E3779B97F4A7C15)))
        out[held] = np.where(found == 0, 1, found)
    return out


def signatures(columns: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Hashes of columns and size classes, in which sets meet."""
    return mix(columns ^ (role.astype(U) + U(1)) * U(0x94D049BB133111EB))


def _pack(sig: np.ndarray, key: np.ndarray, star: np.ndarray) -> bytes:
    """Signatures (48 bits, the lowest for ``star``) with indices into the distinct keys."""
    keys, index = np.unique(key, return_inverse=True)
    short = (sig >> U(17) << U(1)) | star.astype(U)
    small = np.stack([(short >> U(s)).astype(np.uint16) for s in (0, 16, 32)])
    index = index.astype(np.uint16 if len(keys) <= 0x10000 else np.uint32)
    return np.array([len(sig), len(keys)], np.int64).tobytes() + keys.tobytes() + small.tobytes() + index.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures with their star bit, and keys."""
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    keys = np.frombuffer(data, np.int64, k, 16)
    small = np.frombuffer(data, np.uint16, 3 * n, 16 + 8 * k).reshape(3, n).astype(U)
    index = np.frombuffer(data, np.uint16 if k <= 0x10000 else np.uint32, n, 16 + 8 * k + 6 * n)
    return small[0] | small[1] << U(16) | small[2] << U(32), keys[index]


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, key) sorted, the begin of each group, the size of each group."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[fresh], key[fresh]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return sig, key, begin, np.diff(begin, append=len(sig))


PACK_SCHEMA = "bucket int, rows binary, done binary"
MEMBER_SCHEMA = "sig long, key long, leader long"


def _members(docs: DataFrame, plan: Plan, held_common: Broadcast, buckets: int) -> DataFrame:
    """``sig, key, leader`` of every set that has a leading column which several sets have; the leader is one of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(*held_common.value)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        roles: dict[int, list[int]] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            size = [len(x) for x, *_ in held]
            sig = signatures(np.concatenate([x for x, *_ in held]), np.repeat(np.array([r for _, _, r in held]), size))
            key = np.repeat(np.array([k for _, k, _ in held], np.int64), size)
            held.clear()
            sig, key, begin, size = _stars(sig, key)
            star = size > 1
            leader = np.repeat(key[begin], size)
            rest = np.ones(len(sig), bool)
            rest[begin] = False
            # members of a star go on as they are; of each group its leader alone meets other tasks' groups
            done = np.stack([signed(sig[rest]), key[rest], leader[rest]])
            sig, key = sig[begin], key[begin]
            bucket = ((sig >> U(48)) * U(buckets) >> U(16)).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            cut = np.linspace(0, done.shape[1], buckets + 1).astype(np.int64)
            ids, rows, through = [], [], []
            for b in range(buckets):
                a, z = edge[b], edge[b + 1]
                if a < z or cut[b] < cut[b + 1]:
                    ids.append(b)
                    rows.append(_pack(sig[a:z], key[a:z], star[a:z]))
                    through.append(done[:, cut[b] : cut[b + 1]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(rows, pa.binary()), pa.array(through, pa.binary())], ["bucket", "rows", "done"])

        for batch in batches:
            for grams, edges in ngram_sets(batch.column(0), plan.n):
                counts = common.counts(grams)
                for key, a, b in zip(set_keys(grams, edges).tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if a == b or key in seen:
                        continue
                    seen.add(key)
                    if b - a not in roles:
                        roles[b - a] = plan.roles(b - a)
                    if not roles[b - a]:
                        continue
                    # a copy, as a view would keep the whole range
                    first = leading(grams[a:b], counts[a:b], plan.leading(b - a)).copy()
                    held += [(first, key, role) for role in roles[b - a]]
                    total += len(first) * len(roles[b - a])
                    if total >= FLUSH:
                        yield flush()
                        seen.clear()
                        total = 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for batch in batches:
            for rows, done in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                a, b = _unpack(rows)
                sigs.append(a)
                keys.append(b)
                if done:
                    sig, key, leader = np.frombuffer(done, np.int64).reshape(3, -1)
                    yield _member_rows(signed(sig.view(U) >> U(17)), key, leader)
        sig, key = np.concatenate(sigs), np.concatenate(keys)
        starred = np.unique(sig[(sig & U(1)) == 1] >> U(1))
        sig, key, begin, size = _stars(sig >> U(1), key)
        shared = np.repeat(size > 1, size) | np.isin(sig, starred)
        leader = np.repeat(key[begin], size)
        if shared.any():
            yield _member_rows(signed(sig[shared]), key[shared], leader[shared])

    packed = docs.select("text").mapInArrow(relieved(send), PACK_SCHEMA)
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(relieved(meet), MEMBER_SCHEMA)


def _member_rows(sig: np.ndarray, key: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(leader)], ["sig", "key", "leader"])


PROFILE_SCHEMA = "doc_id long, row long, n_shingles long, key long, columns binary, gram long, times long"


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, row, n_shingles, key, columns`` of each row of ``docs(doc_id, row, text)``; the key is null for the empty set.

    ``columns`` counts the n-grams of each of ``BINS`` columns, once a task for each set. Rows with a ``gram`` instead say
    how often it repeats among ``FLUSH`` n-grams of a task.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in PROFILE_SCHEMA.split(", ")]

    def repeats(held: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = np.unique(np.concatenate(held), return_counts=True)
        grams, times = signed(grams[times > 1]), times[times > 1]
        held.clear()
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(grams), k) for k in kinds[:5]), pa.array(grams), pa.array(times, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            sizes, keys, columns = [], [], []
            for grams, edges in ngram_sets(batch.column(2), n):
                own = set_keys(grams, edges).tolist()
                sizes += np.diff(edges).tolist()
                keys += [k or None for k in own]
                for key, a, b in zip(own, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if a == b or key in seen:
                        columns.append(None)
                        continue
                    seen.add(key)
                    columns.append(column_counts(grams[a:b]))
                    held.append(grams[a:b].copy())
                    total += b - a
                    if total >= FLUSH:
                        yield repeats(held)
                        total = 0
            if len(seen) > FLUSH:
                seen.clear()
            nulls = [pa.nulls(len(sizes), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(columns, pa.binary()), *nulls], names)
        if held:
            yield repeats(held)

    return docs.select("doc_id", "row", "text").mapInArrow(relieved(run), PROFILE_SCHEMA)


def _common(profile: DataFrame) -> Broadcast:
    """The common columns and their counts: ``COMMON_COLUMNS`` at most."""
    sums = profile.where("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON)
    found = sums.orderBy(F.desc("times"), "gram").limit(COMMON_COLUMNS).toPandas()
    pair = (found["gram"].to_numpy(np.int64).view(U), found["times"].to_numpy(np.int64))
    return profile.sparkSession.sparkContext.broadcast(pair)


def column_counts(grams: np.ndarray) -> bytes:
    return np.minimum(np.bincount((grams & U(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, profile: DataFrame, n: int, keys: DataFrame) -> DataFrame:
    """``key, grams``: the sets that ``keys`` names, each once; only a text of each is read again."""
    rows = profile.join(keys, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row")).select("row").distinct()
    if rows.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = F.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams, edges in ngram_sets(batch.column(0), n):
                sets = [grams[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(grams, edges)), pa.array(sets, pa.binary())], ["key", "grams"])

    found = docs.join(rows, "row", "left_semi").select("text").mapInArrow(relieved(run), "key long, grams binary")
    return found.dropDuplicates(["key"])


def _possible(pairs: DataFrame, outlines: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``a, b`` whose sizes and column counts allow a link; other columns of ``pairs`` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for k in (0, 2))
            s, t = (batch.column(k).to_numpy() for k in (1, 3))
            ok = _allowed(left, right, s, t, plan)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in batch.columns[4:]], batch.schema.names[4:])

    kept = pairs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    near = pairs.join(outlines.select(F.col("key").alias("b"), F.col("columns").alias("__cb"), F.col("n_shingles").alias("__nb")), "b")
    near = near.join(outlines.select(F.col("key").alias("a"), F.col("columns").alias("__ca"), F.col("n_shingles").alias("__na")), "a")
    return near.select("__ca", "__na", "__cb", "__nb", *kept).mapInArrow(relieved(run), schema)


def _allowed(left: np.ndarray, right: np.ndarray, s: np.ndarray, t: np.ndarray, plan: Plan) -> np.ndarray:
    """Whether column counts differ by no more than a link allows; their L1 distance is at most the sets' difference."""
    total = s + t
    return np.abs(left - right).sum(1) <= total - 2 * -(-plan.num * total // (plan.num + plan.den))


def product(left: np.ndarray, left_edges: np.ndarray, right: np.ndarray, right_edges: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Overlaps of the pairs of a tile, row ``i`` of the left incidence block with row ``i`` of the right one.

    Rows are ascending columns between successive edges. Overlaps are accumulated over column blocks for all pairs at once;
    a pair that can't reach its ``need`` any more leaves the tile with -1.
    """
    m, blocks = len(need), 1 << BLOCK_BITS
    pair_l, pair_r = (np.repeat(np.arange(m, dtype=np.int64), np.diff(e)) for e in (left_edges, right_edges))
    block_l, block_r = ((x >> U(64 - BLOCK_BITS)).astype(np.int64) for x in (left, right))
    rest_l, rest_r = (np.bincount(p * blocks + b, minlength=m * blocks).reshape(m, blocks)[:, ::-1].cumsum(1)[:, ::-1] for p, b in ((pair_l, block_l), (pair_r, block_r)))
    got, live = np.zeros(m, np.int64), np.ones(m, bool)
    for k in range(blocks):
        live &= got + np.minimum(rest_l[:, k], rest_r[:, k]) >= need
        if not live.any():
            break
        own_l, own_r = live[pair_l] & (block_l == k), live[pair_r] & (block_r == k)
        x, y = left[own_l], right[own_r]
        if not len(x) or not len(y):
            continue
        # the pair's number in front of the column; of its last bits, which fall off, two values are looked at
        at_x, at_y = (p.astype(U) << U(52) | v << U(BLOCK_BITS) >> U(12) for p, v in ((pair_l[own_l], x), (pair_r[own_r], y)))
        place = np.searchsorted(at_x, at_y)
        hit = np.zeros(len(y), bool)
        for ahead in (0, 1):
            near = np.minimum(place + ahead, len(x) - 1)
            hit |= (x[near] == y) & (at_x[near] == at_y)
        got += np.bincount(pair_r[own_r][hit], minlength=m)
    return np.where(live & (got >= need), got, -1)


def _linked(left: list[np.ndarray], right: list[np.ndarray], plan: Plan) -> np.ndarray:
    """Whether each pair of sets links, by tiles of pairs."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    need = plan.least_overlap(sizes[:, 0], sizes[:, 1])
    out, lo = np.zeros(len(left), bool), 0
    ends = np.cumsum(sizes.sum(1))
    while lo < len(left):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ENTRIES, "right"))
        hi = min(max(hi, lo + 1), lo + PAIRS, len(left))
        edges = np.concatenate([np.zeros((1, 2), np.int64), sizes[lo:hi].cumsum(0)])
        out[lo:hi] = product(np.concatenate(left[lo:hi]), edges[:, 0], np.concatenate(right[lo:hi]), edges[:, 1], need[lo:hi]) >= 0
        lo = hi
    return out


def _multiply(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """``a, b, linked`` of each pair of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x.as_buffer(), U) for x in batch.column(k)] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_linked(left, right, plan))], ["a", "b", "linked"])

    own = sets.select("key", "grams")
    right = pairs.join(own.withColumnsRenamed({"key": "b", "grams": "right"}), "b")
    both = right.join(own.withColumnsRenamed({"key": "a", "grams": "left"}), "a")
    return both.select("a", "b", "left", "right").mapInArrow(relieved(run), "a long, b long, linked boolean")


def _cells(rows: DataFrame, work: Workspace, tile: int, step: str = "") -> DataFrame:
    """``lead, cell, key, root, home, minor`` from ``lead, key, root``: the tiles in which rows of a group meet.

    Each row has a home tile. Rows outside the group's largest component visit the group's other tiles too, so a group of
    n rows sends n rows and ``n / tile`` for each row that its largest component doesn't hold.
    """
    parts = rows.groupBy("lead", "root").agg(F.count("*").alias("n"))
    groups = parts.groupBy("lead").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("major"))
    groups = work.keep(groups.select("lead", "major", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), f"groups-{step}")
    placed = rows.join(groups, "lead").withColumn("minor", F.col("root") != F.col("major")).withColumn("own", F.pmod(F.hash("key"), "tiles"))
    near = placed.where(~F.col("minor") | (F.col("tiles") == 1)).select("lead", F.col("own").alias("cell"), "key", "root", F.lit(True).alias("home"), "minor")
    far = placed.where(F.col("minor") & (F.col("tiles") > 1)).withColumn("cell", F.explode(F.expr("sequence(0, tiles - 1)")))
    return near.union(far.select("lead", "cell", "key", "root", (F.col("cell") == F.col("own")).alias("home"), "minor"))


def _across(cells: DataFrame, plan: Plan, nearest: bool = False) -> DataFrame:
    """``a, b`` of the rows of a tile that are in different components and whose bounds allow a link.

    ``nearest`` gives each visiting row the home row with the least histogram distance alone.
    """

    def pairs(held: list[tuple[int, int, bool, bool, int, bytes]]) -> Iterator[pa.RecordBatch]:
        key, root, home, minor, size = (np.array([x[k] for x in held]) for k in range(5))
        counts = np.frombuffer(b"".join(x[5] for x in held), np.uint8).reshape(-1, BINS).astype(np.int16)
        stay, visitors = np.flatnonzero(home), np.flatnonzero(minor)
        for lo in range(0, len(visitors), VISIT):
            some = visitors[lo : lo + VISIT, None]
            # of two rows outside the largest component the lesser one visits
            met = (root[stay] != root[some]) & (~minor[stay] | (key[stay] > key[some]))
            met &= np.minimum(size[stay], size[some]) * plan.den >= np.maximum(size[stay], size[some]) * plan.num
            i, j = np.nonzero(met)
            i, j = visitors[lo + i], stay[j]
            far = np.concatenate([np.zeros(0, np.int64), *(np.abs(counts[i[k : k + TOGETHER]] - counts[j[k : k + TOGETHER]]).sum(1) for k in range(0, len(i), TOGETHER))])
            near = far <= size[i] + size[j] - 2 * plan.least_overlap(size[i], size[j])
            i, j, far = i[near], j[near], far[near]
            if nearest and len(i):
                order = np.lexsort((key[j], far, i))
                i, j = i[order], j[order]
                first = np.concatenate([[True], i[1:] != i[:-1]])
                i, j = i[first], j[first]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple[int, int, bool, bool, int, bytes]] = []
        for batch in batches:
            for lead, cell, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lead, cell) != group:
                    if len(held) > 1:
                        yield from pairs(held)
                    group, held = (lead, cell), []
                held.append(tuple(rest))
        if len(held) > 1:
            yield from pairs(held)

    dealt = cells.select("lead", "cell", "key", "root", "home", "minor", "n_shingles", "columns").repartition("lead", "cell").sortWithinPartitions("lead", "cell")
    return dealt.mapInArrow(relieved(run), "a long, b long").distinct()


def _rooted(frame: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """``frame`` with the component of ``column``: the row itself where it hangs on none."""
    return frame.join(roots.select(F.col("node").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _join(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, n_shingles, key`` of each row of ``docs(doc_id, row, text)``, and ``node, root`` of linked sets."""
    spark = docs.sparkSession
    work, plan = Workspace(spark, "jaccard"), Plan(n, num, den)
    profile = work.keep(_profile(docs, n), "profile")
    common = _common(profile)
    profile = profile.where("gram is null").drop("gram", "times")
    outlines = profile.where("columns is not null").select("key", "n_shingles", "columns")
    leading = outlines.agg(F.sum(F.expr(f"n_shingles - ({num} * n_shingles + {den - 1}) div {den} + 1"))).first()[0] or 0
    buckets = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16), -(-leading // MEET))
    members = work.keep(_members(docs, plan, common, buckets), "members")
    stars = members.where("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    stars = work.keep(stars, "stars")
    outlines = outlines.join(stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    outlines = work.keep(outlines, "outlines")
    possible = work.keep(_possible(stars, outlines, plan), "possible")
    sets = work.keep(_sets(docs, profile, n, _keys(possible)), "sets")
    done = work.keep(_multiply(possible.select("a", "b"), sets, plan), "tested")
    work.drop("sets")
    roots = components(done.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), work, "joined")

    # columns whose members are still in several components; of two members the pair has been tested. Columns with one
    # least member have most members in common, so these are gathered by it, once for all such columns
    rooted = work.keep(_rooted(members.select("sig", "key"), "key", roots, "root"), "rooted")
    work.drop("members")
    mixed = rooted.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.min("key").alias("lead"))
    rows = rooted.join(mixed.where("low <> high and size > 2").select("sig", "lead"), "sig").groupBy("lead", "key").agg(F.first("root").alias("root"))
    rows = work.keep(rows, "mixed")
    work.drop("rooted")
    # each row with the nearest row of another component, and what this leaves in several components with all others
    for step in ("nearest", "all"):
        pairs = _across(_cells(rows, work, TILE, step).join(outlines, "key"), plan, step == "nearest")
        pairs = work.keep(pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), f"pairs-{step}")
        if not pairs.limit(1).count():
            continue
        tested = work.keep(_multiply(pairs, work.keep(_sets(docs, profile, n, _keys(pairs)), "sets"), plan), f"tested-{step}")
        done = done.union(tested)
        roots = components(done.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), work, f"joined-{step}")
        if step == "nearest":
            rows = _rooted(rows.select("lead", "key"), "key", roots, "root")
            several = rows.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead")
            rows = work.keep(rows.join(several, "lead", "left_semi"), "mixed-again")
    for name in ("stars", "outlines", "possible", "sets", "mixed", "mixed-again", "pairs-nearest", "pairs-all"):
        work.drop(name)
    return profile.drop("columns"), roots


#: A key of a row: rows with one id and one text are alike.
ROW = ("doc_id", "text")


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs(doc_id, text)``.

    Rows link when ``den * intersection >= num * union`` of their word n-gram sets; the component is the least doc_id
    that links reach.
    """
    profile, roots = _join(docs.select("doc_id", F.xxhash64(*ROW).alias("row"), "text"), n, num, den)
    nodes = profile.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    nodes = _rooted(nodes, "key", roots, "root")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    named = Workspace(docs.sparkSession, "jaccard-named").keep(named, "named")
    return profile.join(named, "key", "left").select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def losers(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The row keys (``xxhash64(doc_id, text)``) that go when one row of each component stays, and those of rows that
    stay but stand in the table more than once.

    The least doc_id stays, of equal ones the least row key; null ids come last. Rows without words all stay.
    """
    profile, roots = _join(docs.select("doc_id", F.xxhash64(*ROW).alias("row"), "text"), n, num, den)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = profile.where("key is not null").groupBy("key").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    nodes = _rooted(nodes, "key", roots, "root")
    best = nodes.groupBy("root").agg(F.min("least").alias("best"), F.sum("n").alias("n")).where("n > 1")
    named = Workspace(docs.sparkSession, "jaccard-named").keep(nodes.join(best.select("root", "best"), "root").select("key", F.col("best.row").alias("best")), "named")
    rows = profile.join(named, "key").groupBy("row", "best").agg(F.count("*").alias("n"))
    return rows.where("row <> best").select("row"), rows.where("row = best and n > 1").select("row")


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
