"""Aggregates in which a gap makes the whole group missing, and the moments and quantiles in use.

Missing is NULL; ``present`` turns a NaN that a source brought into NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def gap_aware(aggregate: Column, value: Column) -> Column:
    """``aggregate`` where every row of the group has a value, else NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def reduction(how: str, value: Column, at: Column, weight: Column | None = None) -> Column:
    """A gap-aware reduction of the steps of a cell or window by name; ``at`` orders them."""
    found = {
        "sum": lambda: F.sum(value),
        "mean": lambda: F.avg(value) if weight is None else F.try_divide(F.sum(value * weight), F.sum(weight)),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "first": lambda: F.min_by(value, at),
        "last": lambda: F.max_by(value, at),
    }
    if how not in found:
        raise ValueError(f"{how!r} is no reduction; the reductions are {', '.join(sorted(found))}")
    return gap_aware(found[how](), value)


#: The reduction that a kind of variable has by default, and the kinds that allow extremes.
DEFAULTS = {"total": "sum", "mean": "mean", "daily_rate": "mean", "end_state": "last", "cumulative": "last"}
EXTREMES = frozenset({"end_state", "mean", "daily_rate"})


def reduction_for(kind: str | None, how: str | None) -> str:
    """The reduction to use for a variable of a kind; a kind without a default needs one named."""
    if how is None:
        if kind not in DEFAULTS:
            raise ValueError(f"a variable of kind {kind!r} has no default reduction; name one")
        return DEFAULTS[kind]
    if kind is not None and how in ("min", "max", "first") and kind not in EXTREMES:
        raise ValueError(f"{how!r} has no meaning for a variable of kind {kind!r}")
    if kind is not None and how == "sum" and kind != "total":
        raise ValueError(f"a variable of kind {kind!r} can't be summed")
    return how


def quantiles(value: Column, levels: Sequence[float]) -> Column:
    """Exact quantiles with linear interpolation, missing values skipped, as an array."""
    return F.percentile(value, F.array(*map(F.lit, levels)))


def central(value: Column, mass: float) -> tuple[Column, Column]:
    """Ends of the central interval of a mass."""
    return F.percentile(value, F.lit((1 - mass) / 2)), F.percentile(value, F.lit((1 + mass) / 2))


def log_sum_exp(log_weight: Column, highest: Column) -> Column:
    """``log(sum(exp(x)))`` with the group's highest value given, so nothing overflows."""
    return highest + F.log(F.sum(F.exp(log_weight - highest)))


def sampled_error(random: Column, joint: Column) -> Column:
    """Standard error of a window's mean: random parts average out over all rows, the systematic part doesn't."""
    systematic = F.avg(F.sqrt(F.greatest(joint * joint - random * random, F.lit(0.0))))
    return F.sqrt(F.avg(random * random) / F.count(F.lit(1)) + systematic * systematic)
