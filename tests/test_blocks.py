import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.time import HOUR
from fieldloom.operators import blocks as B
from fieldloom.operators import towers as T
from fieldloom.plans import covariance as V


def frame(n=30):
    g = np.random.default_rng(1)
    return pd.DataFrame({"k": 1, "day": np.sort(g.random(n) * 50), "year": np.arange(n) // 10, "sd": 0.5 + g.random(n), "r": g.standard_normal(n), "label": [("a", "b")[i % 2] for i in range(n)]})


def test_covariances_add_up():
    rows = frame()
    x = rows["day"].to_numpy()
    gap = np.abs(x[:, None] - x)
    total = V.Diagonal("sd") + V.Scaled(V.Shared("r"), 2.0)
    assert np.allclose(total.matrix(rows), np.diag(rows["sd"] ** 2) + 2 * np.outer(rows["r"], rows["r"]))
    within = V.Kernel("day", V.exponential(1.5, 4.0), "year").matrix(rows)
    assert np.allclose(within, np.where(rows["year"].to_numpy()[:, None] == rows["year"].to_numpy(), 2.25 * np.exp(-gap / 4), 0))
    assert np.allclose(V.Kernel("day", V.fading_periodic(1.0, 7.0, 0.5, 30.0)).matrix(rows).diagonal(), 1.0)
    dense = V.Dense("label", ("b", "a"), ((2.0, 0.5), (0.5, 3.0)))
    assert dense.matrix(rows.iloc[:2]).tolist() == [[3.0, 0.5], [0.5, 2.0]]
    with pytest.raises(ValueError, match="lacks"):
        V.Dense("label", ("a",), ((1.0,),)).matrix(rows)


def test_noise_has_the_blocks_covariance(spark):
    rows = frame(4).assign(k=[1, 1, 1, 2])
    kernel = V.Kernel("day", V.exponential(2.0, 30.0))
    noise = B.block_noise(spark.createDataFrame(rows[["k", "day"]]), ["k"], ["day"], kernel, 20_000, 7).toPandas()
    wide = noise.pivot(index="draw", columns="day", values="noise")[rows["day"]].to_numpy()
    want = np.zeros((4, 4))
    want[:3, :3], want[3, 3] = kernel.matrix(rows.iloc[:3]), 4.0
    assert np.allclose(np.cov(wide.T), want, atol=0.15)


def test_likelihood_search_finds_the_scale(spark):
    g = np.random.default_rng(2)
    x = np.arange(400.0)
    r = np.linalg.cholesky(V.Kernel("day", V.exponential(2.0, 8.0)).matrix(pd.DataFrame({"day": x}))) @ g.standard_normal(400)
    rows = spark.createDataFrame(pd.DataFrame({"k": (x // 200).astype(int), "day": x, "r": r}))
    found, _ = B.maximum_likelihood(rows, ["k"], ["day"], "r", lambda p: V.Kernel("day", V.exponential(p[0], p[1])), [1.0, 2.0], rounds=8)
    assert 1.4 < found[0] < 2.8 and 4 < found[1] < 16


def test_block_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(B, "LARGEST", 5)
    with pytest.raises(ValueError, match="may have 5"):
        B._factor(frame(6), V.Diagonal("sd"))


def test_wishart_and_copula():
    g = np.random.default_rng(3)
    psi = np.array([[4.0, 1.0], [1.0, 3.0]])
    mean = np.mean([V.inverse_wishart_draw(g, psi, 8.0) for _ in range(20_000)], axis=0)
    assert np.allclose(mean, psi / (8 - 3), atol=0.03)
    scale, nu = V.wishart_update(np.array([[1.0, 0.0], [0.0, 2.0]]), psi, 8.0)
    assert nu == 10 and scale.tolist() == [[5.0, 1.0], [1.0, 7.0]]
    draws = V.copula_draws(g, 20_000, np.array([[1.0, 0.8], [0.8, 1.0]]), [lambda u: u, lambda u: -np.log1p(-u)])
    assert abs(draws[:, 0].mean() - 0.5) < 0.01 and abs(draws[:, 1].mean() - 1) < 0.03 and np.corrcoef(np.argsort(np.argsort(draws, 0), 0).T)[0, 1] > 0.7


def test_light_lag(spark):
    hours = spark.range(24 * 40).select(F.lit("t").alias("k"), (F.col("id") * HOUR).alias("us"), F.col("id").alias("h"))
    light = lambda shift: F.greatest(F.sin((F.col("h") - shift) * 2 * np.pi / 24), F.lit(0.0))
    steps = hours.withColumns({"measured": light(2), "reference": light(0)})
    assert T.light_lag(steps, ["k"], F.col("us"), HOUR, "measured", "reference").first()["lag"] == 2
    assert T.light_lag(steps.where("h < 480"), ["k"], F.col("us"), HOUR, "measured", "reference").count() == 0
