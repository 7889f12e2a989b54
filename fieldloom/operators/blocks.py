"""Dense linear algebra on blocks of observations: a block is a group, and a matrix never leaves its task.

Blocks have a declared size bound, since a dense factor is cubic in it; a larger one fails with its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.density import LOG_2PI
from fieldloom.plans.covariance import Covariance, Diagonal

LARGEST = 4_000


def _factor(rows: pd.DataFrame, covariance: Covariance) -> np.ndarray:
    if len(rows) > LARGEST:
        raise ValueError(f"a block has {len(rows)} rows; a dense one may have {LARGEST}")
    return np.linalg.cholesky(covariance.matrix(rows))


def _kinds(frame: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keys)


def gaussian_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str, covariance: Covariance) -> DataFrame:
    """Size, misfit ``r' R^-1 r / 2``, log determinant and log density of each block."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        low = _factor(pdf, covariance)
        z = np.linalg.solve(low, pdf[residual].to_numpy(float))
        misfit, log_det = 0.5 * float(z @ z), 2 * float(np.log(np.diag(low)).sum())
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(pdf), "misfit": misfit, "log_det": log_det, "log_density": -misfit - 0.5 * (log_det + len(pdf) * LOG_2PI)}])

    return rows.groupBy(*keys).applyInPandas(one, f"{_kinds(rows, keys)}, n long, misfit double, log_det double, log_density double")


def noise_summary(rows: DataFrame, keys: Sequence[str], order: Sequence[str], covariance: Covariance) -> DataFrame:
    """Median deviation, effective number of independent observations and least eigenvalue of each block; no matrix is made of a diagonal."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        if isinstance(covariance, Diagonal):
            variance = pdf[covariance.deviation].to_numpy(float) ** 2
            ones, least = 1 / np.sqrt(variance), variance.min()
        else:
            low, r = _factor(pdf, covariance), covariance.matrix(pdf)
            ones, variance, least = np.linalg.solve(low, np.ones(len(pdf))), np.diag(r), np.linalg.eigvalsh(r)[0]
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "n": len(pdf), "median_sd": float(np.median(np.sqrt(variance))), "effective_n": float(ones @ ones * np.median(variance)), "least_eigenvalue": float(least)}])

    return rows.groupBy(*keys).applyInPandas(one, f"{_kinds(rows, keys)}, n long, median_sd double, effective_n double, least_eigenvalue double")


def block_noise(rows: DataFrame, keys: Sequence[str], order: Sequence[str], covariance: Covariance, draws: int, seed: int) -> DataFrame:
    """Noise of each block and draw: ``keys, order, draw, noise``; a block's stream depends on its keys alone."""
    kept = [*keys, *order]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        start = int(pd.util.hash_pandas_object(pd.Series(["|".join(str(pdf[k].iloc[0]) for k in keys)]), index=False).iloc[0])
        rng = np.random.Generator(np.random.Philox(key=seed, counter=[0, start, 0, 0]))
        z = _factor(pdf, covariance) @ rng.standard_normal((len(pdf), draws))
        out = pdf[kept].loc[pdf.index.repeat(draws)].reset_index(drop=True)
        return out.assign(draw=np.tile(np.arange(draws), len(pdf)), noise=z.ravel())

    return rows.groupBy(*keys).applyInPandas(one, f"{_kinds(rows, kept)}, draw long, noise double")


def profile(rows: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str, build: Callable[[np.ndarray], Covariance], candidates: Sequence[Sequence[float]]) -> DataFrame:
    """``candidate, log_density``: the summed block density at each candidate's covariance parameters, in one job.

    Candidates are an exploded column, so blocks and candidates are tasks of their own.
    """
    held = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(candidates)], "__c long, __p array<double>")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        low = _factor(pdf, build(np.asarray(pdf["__p"].iloc[0], float)))
        z = np.linalg.solve(low, pdf[residual].to_numpy(float))
        return pd.DataFrame({"candidate": [int(pdf["__c"].iloc[0])], "d": [float(-0.5 * z @ z - np.log(np.diag(low)).sum() - len(pdf) * LOG_2PI / 2)]})

    each = rows.crossJoin(F.broadcast(held)).groupBy(*keys, "__c").applyInPandas(one, "candidate long, d double")
    return each.groupBy("candidate").agg(F.sum("d").alias("log_density"))


def maximum_likelihood(rows: DataFrame, keys: Sequence[str], order: Sequence[str], residual: str, build: Callable[[np.ndarray], Covariance], start: Sequence[float], rounds: int = 6, spread: float = 1.0) -> tuple[np.ndarray, float]:
    """Log-scale coordinate search for the covariance parameters of greatest summed block density.

    Each round evaluates both sides of every coordinate in one job. The step halves where no side is better.
    """
    best, width = np.log(np.asarray(start, float)), spread
    top = -np.inf
    for _ in range(rounds):
        trial = [best] + [best + s * width * np.eye(len(best))[k] for k in range(len(best)) for s in (-1, 1)]
        found = dict(tuple(r) for r in profile(rows, keys, order, residual, build, [np.exp(c) for c in trial]).collect())
        values = [found[i] for i in range(len(trial))]
        k = int(np.argmax(values))
        top = values[k]
        if k == 0:
            width /= 2
        best = trial[k]
    return np.exp(best), float(top)


def noisy_coverage(predictions: DataFrame, observed: DataFrame, on: Sequence[str], mass: float, seed: int, member: str = "member", value: str = "value", sd: str = "standard_deviation", prediction: str = "prediction") -> DataFrame:
    """Share of observations inside the central interval of predictions with their measurement noise added."""
    from fieldloom.functions.aggregates import central
    from fieldloom.operators.ensemble import normal

    both = predictions.join(observed.select(*on, value, sd), list(on))
    noisy = both.withColumn("__y", F.col(prediction) + F.col(sd) * normal(seed, member, *on))
    low, high = central(F.col("__y"), mass)
    per = noisy.groupBy(*on).agg(F.first(value).alias(value), low.alias("low"), high.alias("high"))
    return per.agg(F.count("*").alias("n"), F.avg(F.col(value).between(F.col("low"), F.col("high")).cast("double")).alias("inside"))
