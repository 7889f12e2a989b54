"""Covariances of blocks of observations: declared once, evaluated where a block's rows are."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd


class Covariance:
    """A covariance of the rows of a block, given as a frame in their order."""

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        raise NotImplementedError

    def __add__(self, other: Covariance) -> Covariance:
        return Sum((self, other))


@dataclass(frozen=True)
class Diagonal(Covariance):
    """Independent errors with the deviations of a column."""

    deviation: str

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        return np.diag(rows[self.deviation].to_numpy(float) ** 2)


@dataclass(frozen=True)
class Dense(Covariance):
    """A matrix by the labels of a column, cut to the labels that the block has."""

    label: str
    labels: tuple
    values: tuple[tuple[float, ...], ...]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        place = {x: i for i, x in enumerate(self.labels)}
        if lacking := set(rows[self.label]) - set(place):
            raise ValueError(f"the covariance lacks {sorted(lacking)}")
        at = [place[x] for x in rows[self.label]]
        return np.array(self.values)[np.ix_(at, at)]


@dataclass(frozen=True)
class Kernel(Covariance):
    """A function of the gaps between the values of a column, zero across the groups of another."""

    at: str
    function: Callable[[np.ndarray], np.ndarray]
    within: str | None = None

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        x = rows[self.at].to_numpy(float)
        out = self.function(np.abs(x[:, None] - x[None, :]))
        if self.within is not None:
            g = rows[self.within].to_numpy()
            out = np.where(g[:, None] == g[None, :], out, 0.0)
        return out


@dataclass(frozen=True)
class Shared(Covariance):
    """One error that all rows share, in proportion to a column: ``v v'``."""

    column: str
    factor: float = 1.0

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        v = self.factor * rows[self.column].to_numpy(float)
        return np.outer(v, v)


@dataclass(frozen=True)
class Scaled(Covariance):
    base: Covariance
    factor: float

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        return self.factor * self.base.matrix(rows)


@dataclass(frozen=True)
class Sum(Covariance):
    parts: Sequence[Covariance]

    def matrix(self, rows: pd.DataFrame) -> np.ndarray:
        return np.sum([p.matrix(rows) for p in self.parts], axis=0)


def exponential(sd: float, scale: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda gap: sd**2 * np.exp(-gap / scale)


def fading_periodic(sd: float, period: float, length: float, scale: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda gap: sd**2 * np.exp(-2 * np.sin(np.pi * gap / period) ** 2 / length**2) * np.exp(-gap / scale)


def copula_draws(rng: np.random.Generator, n: int, correlation: np.ndarray, inverse: Sequence[Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """Draws with given marginals (inverse distribution functions) and a Gaussian copula."""
    from statistics import NormalDist

    z = rng.standard_normal((n, len(inverse))) @ np.linalg.cholesky(correlation).T
    u = np.vectorize(NormalDist().cdf)(z)
    return np.stack([f(u[:, i]) for i, f in enumerate(inverse)], axis=1)


def wishart_update(rows: np.ndarray, psi: np.ndarray, nu: float) -> tuple[np.ndarray, float]:
    """Scale and freedom of an inverse-Wishart law given rows of residuals."""
    return psi + rows.T @ rows, nu + len(rows)


def inverse_wishart_draw(rng: np.random.Generator, psi: np.ndarray, nu: float) -> np.ndarray:
    """A draw by Bartlett's factor of the inverse."""
    p = len(psi)
    factor = np.tril(rng.standard_normal((p, p)), -1) + np.diag(np.sqrt(rng.chisquare(nu - np.arange(p))))
    low = np.linalg.cholesky(np.linalg.inv(psi)) @ factor
    return np.linalg.inv(low @ low.T)
