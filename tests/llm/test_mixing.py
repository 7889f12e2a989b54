from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import mixing as X

from .helpers import ODD, alnum, solid


def cells(seed=1):
    g = np.random.default_rng(seed)
    rows = [(s, k, t) for s in ("s0", "s1", "s2") for k in ("en", "de") for t in ("general", "legal")]
    return pd.DataFrame(rows, columns=list(X.MARGINS)).assign(tokens=g.integers(1, 10_000, len(rows)).astype(float))


TARGETS = {"source": {"*": 1.0}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"general": 0.9, "absent": 0.5, "*": 0.1}}


def test_raked_weights_fit_all_marginals():
    table = cells()
    table["w"], gap = X.rake(table, TARGETS)
    assert gap < 1e-8
    assert np.allclose(table.groupby("source")["w"].sum(), 1 / 3) and np.isclose(table.groupby("lang")["w"].sum()["en"], 0.3)
    assert np.isclose(table.groupby("topic")["w"].sum()["general"], 0.9) and np.isclose(table["w"].sum(), 1)


def test_probabilities_keep_the_share():
    tokens, weight = np.array([100.0, 1000.0, 10.0, 0.0]), np.array([0.5, 0.3, 0.2, 0.0])
    p = X.probabilities(tokens, weight, 0.5)
    assert np.isclose((tokens * p).sum(), 0.5 * tokens.sum()) and p[0] == p[2] == 1 and p[3] == 0 and 0 < p[1] < 1
    assert X.probabilities(tokens, weight, 1.0)[:3].tolist() == [1, 1, 1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, None if i % 50 == 0 else ("word " * (5 + i % 40) if i % 7 else "a | b | c | d"), None if i % 31 == 0 else ("en" if i % 3 else "de"), None if i % 41 == 0 else f"s{min(3, i % 9)}", i, "x") for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, weight string").repartition(5)


def test_both_plans_agree_and_draws_repeat(spark, docs):
    a, b = X.mixture(docs, TARGETS, rounds=3), X.mixture(docs.repartition(2), TARGETS, cells_bound=3, rounds=3)
    one, two = ({r["doc_id"]: (r["p_keep"], r["kept"]) for r in x.select("doc_id", "p_keep", "kept").collect()} for x in (a, b))
    assert len(one) == 1500 and one == two
    assert a.columns == ["doc_id", "text", "lang", "source", "n_chars", *X.ADDED]
    kept = a.where("n_words > 0").agg(F.sum(F.col("n_words") * F.col("p_keep")) / F.sum("n_words")).first()[0]
    assert kept == pytest.approx(X.KEEP, abs=1e-6)
    assert a.where("text is null and kept").count() == 0


def topic_of(text):
    words = alnum(text)
    held = {k: sum(w in v.split() for w in words) for k, v in X.TERMS.items()}
    best = min(held, key=lambda k: (-held[k], k))
    return best if held[best] >= 2 and X.TERM_SHARE * held[best] >= len(words) else "general"


def brute(rows, targets, keep, seed):
    """Cells, raking, calibration and draws in plain Python: p_keep and kept of each ``(doc_id, text, lang, source)``."""
    cell = [(s or "unknown", k or "unknown", topic_of(t)) for _, t, k, s in rows]
    size = [len(solid(t)) for _, t, *_ in rows]
    tokens = Counter()
    for c, n in zip(cell, size, strict=True):
        tokens[c] += n
    tokens = {c: n for c, n in tokens.items() if n}
    total = sum(tokens.values())
    weight = {c: n / total for c, n in tokens.items()}
    for _ in range(X.ROUNDS):
        off = 0.0
        for m, margin in enumerate(X.MARGINS):
            want, target = {}, targets.get(margin, {})
            levels = Counter()
            for c, n in tokens.items():
                levels[c[m]] += n
            named = {k: target[k] for k in levels if k != "*" and k in target}
            rest = {k: n for k, n in levels.items() if k not in named}
            for k, n in rest.items():
                want[k] = target["*"] / len(rest) if "*" in target else (max(0, 1 - sum(named.values())) * n / sum(rest.values()) if named else n / total)
            want |= named
            scale = sum(want.values())
            have = Counter()
            for c, w in weight.items():
                have[c[m]] += w
            off = max([off, *(abs(have[k] - want[k] / scale) for k in levels)])
            weight = {c: w * want[c[m]] / scale / have[c[m]] if have[c[m]] else 0.0 for c, w in weight.items()}
        if off < X.CLOSE:
            break
    p, left = {}, {c: w for c, w in weight.items() if w}
    while left:
        scale = (keep * total - sum(tokens[c] for c in p)) / sum(left.values())
        full = [c for c, w in left.items() if w / tokens[c] * scale >= 1]
        if not full:
            p |= {c: w / tokens[c] * scale for c, w in left.items()}
            break
        for c in full:
            p[c] = 1.0
            del left[c]
    out = []
    for (d, t, *_), c, n in zip(rows, cell, size, strict=True):
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        if d is not None:
            h = xxhash.xxh64_intdigest((d % 2**64).to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest((t or "").encode(), h)
        q = round(p.get(c, 0.0) * X.GRID) / X.GRID
        out.append((c[2], n, q, n > 0 and (h >> 11) / 2**53 < q))
    return out


def test_mixture_by_brute_force(spark, docs):
    g = np.random.default_rng(9)
    pool = " ".join(X.TERMS.values()).split() + [f"w{i}" for i in range(60)]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    rows += [(None if i % 5 == 0 else 9_000 + i, " ".join(g.choice(pool, g.integers(1, 90))).title() + ("." if i % 2 else ""), "en" if i % 4 else "fr", f"s{i % 6}") for i in range(600)]
    rows += [(50_000 + i, t, None, None) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for targets, keep in ((TARGETS, 0.5), (X.TARGETS, 0.9), ({}, 0.3)):
        want = Counter(zip((r[0] for r in rows), brute(rows, targets, keep, X.SEED), strict=True))
        got = Counter((r["doc_id"], (r["topic"], r["n_words"], r["p_keep"], r["kept"])) for r in X.mixture(frame, targets, keep).collect())
        assert got == want


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [(i, "some words here", "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gap = {X.mixture(frame, {"lang": {"en": 0.9, "de": 0.1}, "source": {"a": 0.1, "b": 0.9}}, cells_bound=n, rounds=4).first()["fit_gap"] for n in (1, 100)}
    assert all(0.5 < g < 0.9 for g in gap)


def test_null_levels_and_empty(spark, docs):
    assert X.mixture(docs.limit(0)).count() == 0
    assert X.mixture(docs.where("text is null")).where("kept").count() == 0
    only = docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    found = X.mixture(only).agg(F.count_if("kept"), F.count("*")).first()
    assert 0 < found[0] < found[1]
