"""Residual time series: running means, autocorrelation, recurring parts, and summaries by week, season and year.

Lags and circular neighbours are equi-joins on shifted keys, so they are distributed by series and day; a running mean on
a daily grid is a window over one series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.time import season, week_of_year


def daily_grid(rows: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Every day from a series' first to its last, with NULL where it has no row."""
    span = rows.groupBy(*keys).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    grid = span.select(*keys, F.explode(F.sequence("__lo", "__hi")).alias(day))
    return grid.join(rows.select(*keys, day, value), [*keys, day], "left")


def running_mean(grid: DataFrame, keys: Sequence[str], day: str, value: str, width: int = 31, least: int = 5) -> DataFrame:
    """Centered mean over ``width`` days of a daily grid where at least ``least`` are present; on unobserved days too."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(width // 2), width // 2)
    return grid.withColumn("slow", F.when(F.count(value).over(w) >= least, F.avg(value).over(w))).withColumn("fast", F.col(value) - F.col("slow"))


def variance_split(smoothed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sample variances of a series and of its slow and fast parts."""
    return smoothed.groupBy(*keys).agg(F.var_samp(value).alias("variance"), F.var_samp("slow").alias("slow_variance"), F.var_samp("fast").alias("fast_variance"), F.count(value).alias("n"))


def autocorrelation(rows: DataFrame, keys: Sequence[str], day: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Pearson correlation of a series with itself some days later, over days on which both are present."""
    held = rows.select(*keys, day, value).where(F.col(value).isNotNull())
    later = held.select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(day).alias("__day"), F.col(value).alias("__later")).withColumn(day, F.expr(f"date_sub(__day, lag)"))
    pairs = held.join(later, [*keys, day])
    return pairs.groupBy(*keys, "lag").agg(F.corr(value, "__later").alias("correlation"), F.count("*").alias("n"))


def weekly_means(rows: DataFrame, keys: Sequence[str], day: str, value: str, week: Column | None = None) -> DataFrame:
    return rows.groupBy(*keys, F.year(day).alias("year"), (week if week is not None else week_of_year(F.col(day))).alias("week")).agg(F.avg(value).alias("mean"))


def weekly_by_year(rows: DataFrame, day: str, value: str, years: Sequence[int], week: Column | None = None) -> DataFrame:
    """One row for each of 52 weeks, with the mean of each year in a column of its own."""
    weeks = rows.sparkSession.range(1, 53).select(F.col("id").cast("int").alias("week"))
    found = rows.groupBy((week if week is not None else week_of_year(F.col(day))).alias("week")).agg(*(F.avg(F.when(F.year(day) == y, F.col(value))).alias(f"y{y}") for y in years))
    return weeks.join(found, "week", "left")


def circular_smooth(weekly: DataFrame, keys: Sequence[str], index: str, value: str, period: int = 52, reach: int = 2) -> DataFrame:
    """Mean over the places up to ``reach`` away on a circle, missing ones skipped."""
    near = weekly.select(*keys, F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("__k"), F.col(index).alias("__i"), F.col(value).alias("__v"))
    near = near.withColumn(index, (F.pmod(F.col("__i") - 1 + F.col("__k"), F.lit(period)) + 1).cast(weekly.schema[index].dataType))
    return near.groupBy(*keys, index).agg(F.avg("__v").alias("smooth"))


def recurring_part(rows: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Each row with the smoothed mean of its week over all years, and what is left of it."""
    week = week_of_year(F.col(day))
    weekly = rows.groupBy(*keys, week.alias("week")).agg(F.avg(value).alias("mean"))
    smooth = circular_smooth(weekly, keys, "week", "mean")
    return rows.withColumn("week", week).join(smooth, [*keys, "week"], "left").withColumnRenamed("smooth", "recurring").withColumn("remainder", F.col(value) - F.col("recurring"))


def seasonal_means(rows: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Mean of each season by the month of the window's start, in a column of its own."""
    names = ("djf", "mam", "jja", "son")
    return rows.groupBy(*keys).agg(*(F.avg(F.when(season(F.col(at)) == i, F.col(value))).alias(n) for i, n in enumerate(names)))


def year_correlations(weekly: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """Correlation of each year's weekly means with the mean of the other years' in the same week, over enough weeks."""
    w = Window.partitionBy(*keys, "week")
    others = (F.sum("mean").over(w) - F.col("mean")) / (F.count("mean").over(w) - 1)
    held = weekly.where("mean is not null").withColumn("others", F.when(F.count("mean").over(w) > 1, others)).where("others is not null")
    return held.groupBy(*keys, "year").agg(F.corr("mean", "others").alias("correlation"), F.count("*").alias("n")).where(F.col("n") > least)


def residuals_from_median(predictions: DataFrame, observed: DataFrame, on: Sequence[str], value: str = "value", prediction: str = "prediction") -> DataFrame:
    """Observed value less the ensemble's median at each observation."""
    middle = predictions.groupBy(*on).agg(F.median(prediction).alias("median"))
    return observed.join(middle, list(on)).withColumn("residual", F.col(value) - F.col("median"))


def residual_summary(residuals: DataFrame, keys: Sequence[str], residual: str, sd: str) -> DataFrame:
    """Count, mean, sample variance, and the deviation beyond the stated errors."""
    variance = F.var_samp(residual)
    return residuals.groupBy(*keys).agg(
        F.count(residual).alias("n"), F.avg(residual).alias("mean"), variance.alias("variance"), F.sqrt(F.greatest(variance - F.avg(F.col(sd) * F.col(sd)), F.lit(0.0))).alias("excess_sd")
    )


def step_means(snapshots: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """Mean over the step that ends at each snapshot: of it and the one before; the first uses itself."""
    w = Window.partitionBy(*keys).orderBy(time)
    return snapshots.withColumn("step_mean", (F.coalesce(F.lag(value).over(w), F.col(value)) + F.col(value)) / 2)


def exponential_filter(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, tau: float, seed_steps: int) -> DataFrame:
    """Causal filter ``s += (x - s) / tau`` in order, seeded by the mean of the first ``seed_steps`` values.

    A fold is sequential within a series; series are independent. The state runs through sorted Arrow batches, so a series
    of any length passes through a task in pieces.
    """
    import numpy as np
    import pandas as pd

    schema = rows.schema.simpleString()[len("struct<") : -1]
    columns = rows.columns

    keep, block = 1 - 1 / tau, 128
    # a block's states from its values and the state before: s = L x + keep ** (1..n) * s0
    power = keep ** np.arange(block + 1)
    lower = np.tril(power[np.abs(np.subtract.outer(np.arange(block), np.arange(block)))]) / tau

    def run(batches):
        group, state = None, 0.0
        for pdf in batches:
            out = np.empty(len(pdf))
            x, lead = pdf[value].to_numpy(float), pdf["__seed"].to_numpy(float)
            ids = pdf.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy() if keys else np.zeros(len(pdf), int)
            edges = np.flatnonzero(np.diff(ids, prepend=-1)) if len(pdf) else []
            for a, b in zip(edges, [*edges[1:], len(pdf)], strict=True):
                own = tuple(pdf[k].iloc[a] for k in keys)
                if own != group:
                    group, state = own, lead[a]
                for lo in range(a, b, block):
                    n = min(block, b - lo)
                    out[lo : lo + n] = lower[:n, :n] @ x[lo : lo + n] + power[1 : n + 1] * state
                    state = out[lo + n - 1]
            yield pd.concat([pdf[columns], pd.Series(out, name="filtered", index=pdf.index)], axis=1)

    w = Window.partitionBy(*keys).orderBy(*order)
    seeds = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= seed_steps).groupBy(*keys).agg(F.avg(value).alias("__seed"))
    dealt = rows.join(seeds, list(keys)).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", filtered double") if schema else rows


def annual_totals(steps: DataFrame, keys: Sequence[str], start: str, value: str, length: Column, steps_in_year: Column, factor: float = 1.0, share: float = 0.99) -> DataFrame:
    """Total of each year of step starts that has no gap and at least a share of its steps."""
    by = steps.withColumn("year", F.year(start)).groupBy(*keys, "year")
    found = by.agg(F.sum(F.col(value) * length * factor).alias("total"), F.count(value).alias("present"), F.count("*").alias("n"), F.max(steps_in_year).alias("possible"))
    return found.where((F.col("present") == F.col("n")) & (F.col("n") >= share * F.col("possible"))).select(*keys, "year", "total", "n")


def best_lag(series: DataFrame, keys: Sequence[str], index: str, left: str, right: str, lags: Sequence[int], period: int | None = None) -> DataFrame:
    """The shift of ``right`` against ``left`` with the highest correlation; circular where a period is given."""
    moved = series.select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(index).alias("__i"), F.col(right).alias("__r"))
    place = F.col("__i") + F.col("lag")
    moved = moved.withColumn(index, (F.pmod(place, F.lit(period)) if period else place).cast(series.schema[index].dataType))
    both = series.select(*keys, index, left).join(moved, [*keys, index])
    per = both.groupBy(*keys, "lag").agg(F.corr(left, "__r").alias("correlation"))
    # of equal correlations the smaller shift
    return per.groupBy(*keys).agg(F.max_by("lag", F.struct("correlation", -F.abs("lag"), -F.col("lag"))).alias("lag"), F.max("correlation").alias("correlation"))
