import hashlib
import random

import numpy as np
import pytest

from fieldloom.llm import winnowing as W

from .helpers import ODD, alnum, documents, wide


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = alnum(text)
        for p in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + min(10, len(w))]), set()).add(str(name))
    out = {}
    for d, text in docs:
        w, hit, names = alnum(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if found := windows.get(tuple(w[p : p + size])):
                    names |= found
                    hit.update(range(p, p + size))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names - {"None"})).encode()).hexdigest(), bool(hit))
    return out


def tables(seed):
    g = random.Random(seed)
    vocabulary = ["a", "b", "c", "the", "of", "w1", "w2", "w3"]
    items = [(i, " ".join(g.choice(vocabulary) for _ in range(g.choice([1, 3, 9, 10, 11, 30])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "!!"), (5, "the same id, again"), (33, "A b a B a b a b a b a b a b"), (None, "lost words of nobody"), (None, "another a b a b a b a b a b a without an id"), (40, "lost words of nobody")]
    texts = list(ODD)
    for _ in range(60):
        x = [g.choice([*vocabulary, "z", "y"]) for _ in range(g.randrange(0, 60))]
        for _ in range(g.randrange(3)):
            x += ["lost", "words", "of", "nobody"] if g.random() < 0.2 else []
            x += alnum(g.choice(items)[1])[g.randrange(3) :] + [g.choice(["z", "..."])]
        texts.append(g.choice([" ", ", ", "\n"]).join(x))
    return texts, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("long_only", [False, True])
def test_by_brute_force(spark, broadcast, long_only):
    texts, items = tables(3)
    items = [x for x in items if not long_only or len(alnum(x[1])) >= 10]
    frame, bench = wide(documents(spark, texts)), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in W.contamination(frame, bench, broadcast_windows=broadcast).collect()}
    assert got == brute(list(enumerate(texts)), items)


def test_empty_tables_and_repeats(spark):
    frame, bench = documents(spark, ["a b c", "a b c"]), spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert W.contamination(frame.limit(0), bench).count() == 0
    assert [r["contaminated"] for r in W.contamination(frame, bench.limit(0)).collect()] == [False, False]
    assert W.contamination(frame.union(frame), bench).where("n_hit = 2").count() == 4
    assert W.contamination(frame.union(frame), bench, broadcast_windows=0).where("n_hit = 2").count() == 4


def test_winnow_takes_the_least_of_each_stretch():
    g = np.random.default_rng(2)
    for n in (0, 3, 5, 40):
        x = g.integers(0, 6, n).astype(np.uint64)
        want = sorted({p + max(j for j in range(5) if x[p + j] == x[p : p + 5].min()) for p in range(n - 4)})
        assert W.winnow(x, 5).tolist() == want
