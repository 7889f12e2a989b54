import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import density as D
from fieldloom.inference import eki, smc
from fieldloom.operators import ensemble as E
from fieldloom.operators import weights as W
from fieldloom.plans import model as M
from fieldloom.plans.layout import Component, Layout
from fieldloom.plans.support import Interval, PositiveDefinite, Simplex


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_densities_integrate_to_one(spark):
    grid = spark.range(1, 200_001).select((F.col("id") / 2000.0).alias("x"))
    for law in (lambda x: D.log_normal(x, 3.0, 1.6), lambda x: D.logit_normal(x, 0.0, 100.0, 30.0, 0.7), lambda x: D.inverse_gamma(x, 3.0, 4.0), lambda x: D.normal(x, 50.0, 4.0)):
        assert grid.agg(F.sum(F.exp(law(F.col("x")))) / 2000).first()[0] == pytest.approx(1, abs=2e-3)
    assert value(spark, D.log_normal(F.lit(-1.0), 1.0, 2.0)) == -math.inf


def test_special_functions(spark):
    for x in (0.1, 0.5, 1.0, 7.3, 120.0):
        assert value(spark, D.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)
    assert D.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12) and D.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    low, high = D.log_normal_interval(1.0, 9.0)
    assert low == pytest.approx(3.0) and math.log(9 / 3) / math.log(high) == pytest.approx(1.959963984540054)


def test_chi_square_tail_of_many_rows():
    """Degrees of freedom as of 36 million rows; the values are from the whole series with 45 digits."""
    for x, want in ((36_037_237.743097238895, 5.744220853733907e-06), (36_000_000 + 0.5 * math.sqrt(72e6), 0.3085167931795037), (36_000_000 - 3 * math.sqrt(72e6), 0.998652886205062)):
        assert D.chi_square_tail(x, 36_000_000) == pytest.approx(want, abs=1e-7)


def test_block_densities_agree():
    g = np.random.default_rng(1)
    r = g.standard_normal((6, 1))
    one = D.matrix_student(r, np.array([[2.0]]), 4.0, 1)
    a, b, n, q = 2.0, 1.0, 6, float((r * r).sum())
    assert one == pytest.approx(math.lgamma(a + n / 2) - math.lgamma(a) + a * math.log(b) - n / 2 * math.log(2 * math.pi) - (a + n / 2) * math.log(b + q / 2))
    x = g.standard_normal(4)
    assert D.gaussian_block(x, np.diag([1.0, 2.0, 3.0, 4.0])) == pytest.approx(sum(-0.5 * (v * v / s + math.log(2 * math.pi * s)) for v, s in zip(x, (1, 2, 3, 4), strict=True)))
    assert D.inverse_wishart(np.array([[2.0]]), np.array([[3.0]]), 5.0) == pytest.approx(2.5 * math.log(1.5) - math.lgamma(2.5) - 3.5 * math.log(2.0) - 0.75)


def test_layout_and_supports(spark):
    layout = Layout([Component("rate", {"pft": ["a", "b"]}, support=Interval(0.0)), Component("share", support=Interval(0.0, 1.0)), Component("shift", elements=("x", "y"))])
    assert [layout.entry_name(i) for i in range(len(layout))] == ["rate[pft=a]", "rate[pft=b]", "share", "shift[x]", "shift[y]"]
    assert layout.positions(pft=["b"]) == [1, 2, 3, 4] and layout.positions(["rate"], pft=["b"]) == [1] and layout.slice("shift") == slice(3, 5)
    frame = spark.createDataFrame([(0, [0.5, -1.0, 2.0, 3.0, -4.0])], "k int, free array<double>")
    back = frame.select("k", layout.natural(F.col("free")).alias("x")).select(layout.unconstrained(F.col("x")).alias("y")).first()["y"]
    assert back == pytest.approx([0.5, -1.0, 2.0, 3.0, -4.0])
    s = Simplex()
    three = value(spark, s.natural(F.array(F.lit(1.0), F.lit(-2.0))))
    assert sum(three) == pytest.approx(1) and value(spark, s.unconstrained(F.array(*map(F.lit, three)))) == pytest.approx([1.0, -2.0])
    matrix = spark.createDataFrame([([[2.0, 0.0], [0.0, 1.0]],), ([[1.0, 2.0], [2.0, 1.0]],), (None,)], "m array<array<double>>")
    assert [r[0] for r in matrix.select(PositiveDefinite(2).holds(F.col("m"))).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        Layout([Component("a"), Component("a")])


def test_model_graph(spark):
    parts = [M.Deterministic("m", lambda a: 2 * a, ("a",)), M.Factor("y", lambda m: M.normal_law(m, 1.0), ("m",)), M.Factor("a", lambda: M.normal_law(1.0, 0.5)), M.Factor("z", lambda y: M.normal_law(y, 1.0), ("y",))]
    model = M.Model(parts)
    assert [p.name for p in model.parts] == ["a", "m", "y", "z"]
    posterior = M.Posterior(model, {"y": 3.0})
    assert posterior.targets == ["a"] and posterior.barren == ["z"]
    r = posterior.evaluate(spark.createDataFrame([(0, 1.2)], "sample long, a double")).first()
    assert r["log_density"] == pytest.approx(-0.5 * (0.2 / 0.5) ** 2 - math.log(0.5) - 0.5 * 0.36 - math.log(2 * math.pi))
    draws = model.sample(spark.range(20_000).withColumnRenamed("id", "sample"), 5).agg(F.avg("y"), F.stddev("y")).first()
    assert draws[0] == pytest.approx(2.0, abs=0.05) and draws[1] == pytest.approx(math.sqrt(2.0), abs=0.05)
    for bad in ([M.Factor("a", lambda x: M.normal_law(x, 1.0), ("lost",))], [M.Factor("a", lambda: M.normal_law(0, 1))] * 2, [M.Deterministic("a", lambda b: b, ("b",)), M.Deterministic("b", lambda a: a, ("a",))]):
        with pytest.raises(M.ModelError):
            M.Model(bad)


def problem():
    return smc.Problem(lambda g, n: 2 * g.standard_normal((n, 2)), lambda x: -0.5 * (x**2).sum(1) / 4 - math.log(8 * math.pi), lambda x: -0.5 * ((x - 1) ** 2).sum(1) / 0.04)


def test_smc_evidence_and_resume(spark, tmp_path):
    settings = smc.Settings(n=600, moves=2)
    states = list(smc.run(problem(), settings))
    exact = 2 * (-0.5 * math.log(1 + 4 / 0.04) - 0.5 / (4 + 0.04))
    assert states[-1].log_evidence == pytest.approx(exact, abs=0.3) and states[-1].theta.mean(0) == pytest.approx([1 / 1.01] * 2, abs=0.05)
    half = len(states) // 2
    smc.save(spark, str(tmp_path / "s"), states[half])
    resumed = list(smc.run(problem(), settings, smc.load(spark, str(tmp_path / "s"))))
    assert np.array_equal(resumed[-1].theta, states[-1].theta) and resumed[-1].log_evidence == states[-1].log_evidence


def test_weights(spark):
    assert smc.ess(np.zeros(10)) == pytest.approx(10) and smc.cess(np.zeros(10), np.arange(10.0), 0.0) == pytest.approx(1)
    drawn = smc.resample(np.log(np.array([0.5, 1e-300, 0.5])), 4, 0.5)
    assert drawn.tolist() == [0, 0, 2, 2]
    g = np.random.default_rng(3)
    assert smc.pareto_k(np.log(g.pareto(2.0, 20_000) + 1)) == pytest.approx(0.5, abs=0.15) and math.isnan(smc.pareto_k(np.zeros(5)))
    w = g.random(500)
    w[::7] = 0
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i long, w double").repartition(6)
    got = {r["draw"]: r["i"] for r in W.systematic_resample(frame, "i", "w", 300, 0.41).collect()}
    assert [got[k] for k in range(300)] == np.searchsorted(np.cumsum(w) / w.sum(), (np.arange(300) + 0.41) / 300, side="right").tolist()


def test_eki_repairs_failures_and_resumes():
    g = np.random.default_rng(4)
    a = g.standard_normal((5, 3))
    y, noise = a @ np.array([1.0, 2.0, 3.0]), 0.04 * np.eye(5)

    def forward(t):
        out = t @ a.T
        out[t[:, 0] > 2.5] = np.nan
        return out

    theta = g.standard_normal((300, 3))
    states = eki.invert(theta, forward, y, noise)
    assert states[-1].time == 1.0 and np.isfinite(states[-1].theta).all()
    again = eki.invert(theta, forward, y, noise, state=states[2])
    assert np.array_equal(again[-1].theta, states[-1].theta)
    with pytest.raises(ValueError):
        eki.repair(theta, np.full((300, 5), np.nan), g)


def test_machinery_failures_fail_the_job(spark):
    runs = spark.createDataFrame([(1, 0.5, 1.0)], "sample long, decay double, start double")

    def broken(parameters, forcing):
        raise RuntimeError("the disk is full")

    with pytest.raises(Exception, match="the disk is full"):
        E.fan_out(runs, broken, None, ["sample"], ["decay", "start"], "sample", "sample", "pool double").collect()
