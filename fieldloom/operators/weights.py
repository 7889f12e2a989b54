"""Weighted populations: effective sizes, systematic resampling, and weighted moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.reshape import in_ranges


def effective_sizes(rows: DataFrame, keys: Sequence[str], log_weight: str, log_ratio: str, increment: float) -> DataFrame:
    """Effective size of the weights and conditional effective size of an increment, in logs and two passes.

    The highest terms come first, so no exponential overflows; both passes are partial aggregations.
    """
    lw, step = F.col(log_weight), F.col(log_ratio) * increment
    tops = rows.groupBy(*keys).agg(F.max(lw).alias("__a"), F.max(lw + step).alias("__b"), F.max(lw + 2 * step).alias("__c"))
    held = rows.join(tops, list(keys)) if keys else rows.crossJoin(F.broadcast(tops))  # one row without keys

    def lse(x: Column, top: str) -> Column:
        return F.first(top) + F.log(F.sum(F.exp(x - F.col(top))))

    def lse2(x: Column, top: str) -> Column:
        return 2 * F.first(top) + F.log(F.sum(F.exp(2 * (x - F.col(top)))))

    a, b, c = lse(lw, "__a"), lse(lw + step, "__b"), lse(lw + 2 * step, "__c")
    return held.groupBy(*keys).agg(F.exp(2 * a - lse2(lw, "__a")).alias("ess"), F.exp(2 * b - a - c).alias("cess"), a.alias("log_total"))


def systematic_resample(rows: DataFrame, order: str, weight: str, n: int, u: float) -> DataFrame:
    """``n`` draws with one uniform: draw k takes the row whose stretch of the cumulated weights holds ``(u + k) / n``.

    Weights are cumulated in ranges of the order, then within each range, so no task holds the population. Each row then
    makes its own draws, a sequence, rather than being joined with all of them.
    """
    parts = in_ranges(rows, [order])
    sums = parts.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__start"), F.sum("__sum").over(every).alias("__total"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    high = (F.col("__start") + F.sum(weight).over(within)) / F.col("__total")
    placed = parts.join(F.broadcast(starts), "__part").withColumn("__hi", high).withColumn("__lo", F.col("__hi") - F.col(weight) / F.col("__total"))
    first, last = F.greatest(F.ceil(F.col("__lo") * n - u), F.lit(0)), F.least(F.ceil(F.col("__hi") * n - u) - 1, F.lit(n - 1))
    drawn = placed.withColumns({"__first": first, "__last": last}).where((F.col(weight) > 0) & (F.col("__first") <= F.col("__last")))
    return drawn.withColumn("draw", F.explode(F.sequence("__first", "__last"))).select("draw", *rows.columns)


def weighted_moments(rows: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """Weighted means, and covariances with the weights' small-sample correction, as one row."""
    total = F.sum(weight)
    share = rows.crossJoin(F.broadcast(rows.agg(total.alias("__w")))).withColumn("__p", F.col(weight) / F.col("__w"))
    means = share.agg(*(F.sum(F.col("__p") * F.col(c)).alias(f"mean_{c}") for c in columns), F.sum(F.col("__p") * F.col("__p")).alias("__p2"))
    held = share.crossJoin(F.broadcast(means))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cov = [(F.sum(F.col("__p") * (F.col(a) - F.col(f"mean_{a}")) * (F.col(b) - F.col(f"mean_{b}"))) / (1 - F.first("__p2"))).alias(f"cov_{a}_{b}") for a, b in pairs]
    return held.agg(*(F.first(f"mean_{c}").alias(f"mean_{c}") for c in columns), *cov)


def log_moments(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median and geometric deviation of the log-normal of greatest likelihood."""
    x = F.log(column)
    return rows.groupBy(*keys).agg(F.exp(F.avg(x)).alias("median"), F.exp(F.stddev_pop(x)).alias("geometric_sd"))


def logit_moments(rows: DataFrame, keys: Sequence[str], column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Median and deviation of the logit of the logit-normal of greatest likelihood; a value outside the interval fails."""
    x = F.col(column)
    inside = F.when(~((x > low) & (x < high)), F.raise_error(F.lit("a sample lies outside the support"))).otherwise(x)
    t = F.log((inside - low) / (high - inside))
    center = F.avg(t)
    return rows.groupBy(*keys).agg((low + (high - low) / (1 + F.exp(-center))).alias("median"), F.stddev_pop(t).alias("logit_sd"))


def scale_update(residuals: DataFrame, keys: Sequence[str], residual: str, variance: Column, a: float, b: float) -> DataFrame:
    """Inverse-gamma parameters of each group's variance factor given its residuals; one without keeps the prior."""
    q = F.sum(F.col(residual) * F.col(residual) / variance)
    return residuals.groupBy(*keys).agg((a + F.count(residual) / 2).alias("a"), (b + F.coalesce(q, F.lit(0.0)) / 2).alias("b"))
