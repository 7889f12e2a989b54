import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import jaccard_join as J
from fieldloom.llm.components import components
from fieldloom.llm.shared import Workspace

from .helpers import ODD, documents, solid, wide


def brute(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = solid(t)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d in sorted(sets):
        for e, o in Counter(e for g in sets[d] for e in holders[g] if e < d).items():
            if den * o >= num * (len(sets[d]) + len(sets[e]) - o):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def families(seed, groups, words=200):
    g, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(words)]
    passage = " ".join(g.choice(vocabulary) for _ in range(60))
    for _ in range(groups):
        base = [g.choice(vocabulary) for _ in range(g.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 40, 120]))]
        for _ in range(g.choice([1, 2, 5, 30])):
            x = list(base)
            for _ in range(g.choice([0, 1, 1, 2, 3, max(1, len(base) // 30), max(1, len(base) // 12)])):
                i, how = g.randrange(len(x)), g.random()
                if how < 0.4:
                    x[i] = g.choice(vocabulary)
                elif how < 0.6 and len(x) > 1:
                    del x[i]
                else:
                    x.insert(i, g.choice(vocabulary))
            rows.append(" ".join(x) + (f" {passage}" if g.random() < 0.3 else ""))
    return rows


@pytest.mark.parametrize(("n", "num", "den", "tile", "flush", "common"), [(3, 9, 10, 512, 2_000_000, 16), (5, 4, 5, 4, 500, 2), (1, 1, 2, 8, 2_000, 3)])
def test_components_by_brute_force(spark, monkeypatch, n, num, den, tile, flush, common):
    monkeypatch.setattr(J, "TILE", tile)
    monkeypatch.setattr(J, "FLUSH", flush)
    monkeypatch.setattr(J, "COMMON", common)
    texts = families(n, 25) + ODD + ["A  b", "a b", "same text of five words", "same text of five words"]
    frame = wide(documents(spark, texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(frame, n, num, den).collect()}
    assert got == brute(list(enumerate(texts)), n, num, den)


def test_empty_table_and_repeats(spark):
    frame = documents(spark, ["a b c d", "a b c d"])
    assert J.classes(frame.limit(0), 3, 9, 10).count() == 0
    twice = frame.union(frame)
    assert sorted(tuple(r) for r in J.classes(twice, 3, 9, 10).collect()) == [(0, 2, 0), (0, 2, 0), (1, 2, 0), (1, 2, 0)]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_linked_sets_share_a_leading_column(num, den):
    plan, g = J.Plan(3, num, den), np.random.default_rng(3)
    pool = np.unique(g.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    common = J.Common(pool[::3], g.integers(16, 99, len(pool[::3])))
    for _ in range(2_000):
        a = np.sort(g.choice(pool, g.integers(1, 60), replace=False))
        b = np.union1d(a[g.random(len(a)) < 0.9], g.choice(pool, g.integers(0, 6)))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if den * shared >= num * (len(a) + len(b) - shared):
            assert shared >= plan.least_overlap(len(a), len(b))
            first = [J.leading(x, common.counts(x), plan.leading(len(x))) for x in (a, b)]
            assert len(np.intersect1d(*first)) and [len(x) for x in first] == [plan.leading(len(a)), plan.leading(len(b))]


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_linked_sizes_meet(num, den):
    plan = J.Plan(3, num, den)
    for s in range(1, 400):
        for t in range(s, s * den // num + 1):
            most = s + t - 2 * plan.least_overlap(s, t)
            assert plan.class_of(t) - plan.class_of(s) in (0, 1) and most <= plan.difference(plan.class_of(s))
            assert most == 0 or set(plan.roles(s)) & set(plan.roles(t))
        assert plan.bound(plan.class_of(s)) <= s < plan.bound(plan.class_of(s) + 1)


def test_product_of_tiles(monkeypatch):
    g = np.random.default_rng(1)
    left, right = [], []
    for _ in range(300):
        pool = g.integers(0, 2**63, 60).astype(np.uint64) * np.uint64(2)
        pool[:20] = pool[20:40] + np.uint64(1)  # values that differ in their last bit only
        a, b = (np.unique(g.choice(pool, g.integers(1, 50), replace=False)) for _ in range(2))
        left.append(a)
        right.append(b)
    exact = np.array([len(np.intersect1d(a, b)) for a, b in zip(left, right, strict=True)])
    edges = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in (left, right)]
    whole = (np.concatenate(left), edges[0], np.concatenate(right), edges[1])
    assert J.product(*whole, np.zeros(300, np.int64)).tolist() == exact.tolist()
    need = exact + g.integers(0, 2, 300)
    assert J.product(*whole, need).tolist() == np.where(need > exact, -1, exact).tolist()
    monkeypatch.setattr(J, "PAIRS", 7)
    plan = J.Plan(3, 1, 2)
    assert J._linked(left, right, plan).tolist() == [2 * o >= len(a) + len(b) - o for a, b, o in zip(left, right, exact.tolist(), strict=True)]


def test_rows_stay_linear_in_a_group(spark, monkeypatch):
    """Near copies of one text, of which only those with close changes link: some rows a copy in tiles and products."""
    sent = []
    cells, multiply = J._cells, J._multiply

    def counted(rows, work, tile, step):
        out = cells(rows, work, tile, step)
        sent[-1] += out.count()
        return out

    def products(pairs, sets, plan):
        sent[-1] += pairs.count()
        return multiply(pairs, sets, plan)

    monkeypatch.setattr(J, "_cells", counted)
    monkeypatch.setattr(J, "_multiply", products)
    for copies in (200, 2000):
        g = random.Random(copies)
        base = [f"w{g.randrange(400)}" for _ in range(80)]
        texts = [" ".join(w if i != k else f"x{c}" for i, w in enumerate(base)) for c in range(copies) for k in [g.randrange(80)]]
        sent.append(0)
        assert {r["component_id"] for r in J.classes(documents(spark, texts), 5, 4, 5).collect()} == {0}
    assert sent[0] <= 10 * 200 and sent[1] <= 10 * 2000, sent


def test_cells_of_a_large_component(spark):
    """A group of one component and a few strangers: the component's rows go to one tile each."""
    rows = spark.range(1000).selectExpr("7L as lead", "id as key", "if(id < 990, 1, id) as root")
    cells = J._cells(rows, Workspace(spark, "test"), 100)
    assert cells.count() == 990 + 10 * 10 and cells.where("home").count() == 1000
    met = {(r["a"], r["b"]) for r in J._across(cells.selectExpr("*", "10L as n_shingles", f"cast(repeat('a', {J.BINS}) as binary) as columns"), J.Plan(5, 4, 5)).collect()}
    assert met == {(a, b) for b in range(990, 1000) for a in range(b)}


def test_one_row_of_each_component_stays(spark):
    other, alone = "quite another text of words", "alone with a null id"
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, other), (5, other), (None, "a b c d e f g"), (None, alone), (None, alone), (7, ""), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone, twice = J.losers(frame, 5, 4, 5)
    keyed = {r["row"]: (r["doc_id"], r["text"]) for r in frame.select("*", F.xxhash64(*J.ROW).alias("row")).collect()}
    assert {keyed[r["row"]] for r in gone.collect()} == {(5, "a b c d e f g"), (None, "a b c d e f g")}
    assert {keyed[r["row"]] for r in twice.collect()} == {(5, other), (None, alone)}
    assert [r["component_id"] for r in J.classes(frame.where("doc_id is null and text like 'alone%'"), 5, 4, 5).collect()] == [None, None]


def test_connected_components(spark):
    g = random.Random(5)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2001 + i) for i in range(40)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"), "c").collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}
