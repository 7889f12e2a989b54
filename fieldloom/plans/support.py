"""Supports of values, and the bijectors from the real line."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Support:
    """Where a value may lie."""

    def holds(self, value: Column) -> Column:
        raise NotImplementedError

    def natural(self, free: Column) -> Column:
        raise NotImplementedError

    def unconstrained(self, value: Column) -> Column:
        raise NotImplementedError

    def log_derivative(self, free: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Interval(Support):
    """An open interval; a missing end is infinite. Bijectors: identity, shifted exponential, scaled logistic."""

    low: float | None = None
    high: float | None = None

    def holds(self, value: Column) -> Column:
        ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
        if self.low is not None:
            ok &= value > self.low
        if self.high is not None:
            ok &= value < self.high
        return ok

    def natural(self, free: Column) -> Column:
        if self.low is not None and self.high is not None:
            return self.low + (self.high - self.low) / (1 + F.exp(-free))
        if self.low is not None:
            return self.low + F.exp(free)
        if self.high is not None:
            return self.high - F.exp(-free)
        return free

    def unconstrained(self, value: Column) -> Column:
        if self.low is not None and self.high is not None:
            return F.log((value - self.low) / (self.high - value))
        if self.low is not None:
            return F.log(value - self.low)
        if self.high is not None:
            return -F.log(self.high - value)
        return value

    def log_derivative(self, free: Column) -> Column:
        if self.low is not None and self.high is not None:
            return F.log(F.lit(self.high - self.low)) - free - 2 * F.log1p(F.exp(-free))
        if self.low is not None:
            return free
        if self.high is not None:
            return -free
        return free * 0.0


@dataclass(frozen=True)
class Simplex(Support):
    """Positive entries that sum to one; the free vector is the log ratio to the last entry."""

    tolerance: float = 1e-10

    def holds(self, value: Column) -> Column:
        total = F.aggregate(value, F.lit(0.0), lambda s, x: s + x)
        return F.forall(value, lambda x: x > 0) & (F.abs(total - 1) <= self.tolerance)

    def natural(self, free: Column) -> Column:
        top = F.greatest(F.array_max(free), F.lit(0.0))
        e = F.concat(F.transform(free, lambda x: F.exp(x - top)), F.array(F.exp(-top)))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))

    def unconstrained(self, value: Column) -> Column:
        last = F.element_at(value, -1)
        return F.transform(F.slice(value, 1, F.size(value) - 1), lambda x: F.log(x / last))


@dataclass(frozen=True)
class PositiveDefinite(Support):
    """Symmetric matrices, as nested arrays, with a Cholesky factor."""

    size: int = 1

    def holds(self, value: Column) -> Column:
        size = self.size

        @F.pandas_udf("boolean")
        def factors(rows: pd.Series) -> pd.Series:
            def one(x) -> bool:
                if x is None:
                    return False
                m = np.array([np.asarray(row, float) for row in x])
                if m.shape != (size, size) or not np.allclose(m, m.T):
                    return False
                try:
                    np.linalg.cholesky(m)
                except np.linalg.LinAlgError:
                    return False
                return True

            return rows.map(one)

        return factors(value)
