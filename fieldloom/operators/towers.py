"""Summaries of towers' records: size, clock offset and the lag of measured light."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.analytics import best_lag
from fieldloom.operators.clocks import offset_search

#: Days that a tower must have in every slot of the day before its lag is told.
LEAST_DAYS = 30


def slot_means(steps: DataFrame, keys: Sequence[str], us: Column, step: int, columns: Sequence[str]) -> DataFrame:
    """Means by time of day, of towers with enough days in each slot."""
    slots = 86_400_000_000 // step
    slot = F.floor(F.pmod(us, F.lit(86_400_000_000)) / step)
    means = steps.groupBy(*keys, slot.cast("long").alias("slot")).agg(*(F.avg(c).alias(c) for c in columns), *(F.count(c).alias(f"__n_{c}") for c in columns))
    enough = means.groupBy(*keys).agg(F.count("*").alias("__slots"), F.min(F.least(*(f"__n_{c}" for c in columns)) if len(columns) > 1 else F.col(f"__n_{columns[0]}")).alias("__least"))
    good = enough.where((F.col("__slots") == slots) & (F.col("__least") >= LEAST_DAYS)).select(*keys)
    return means.select(*keys, "slot", *columns).join(good, list(keys))


def light_lag(steps: DataFrame, keys: Sequence[str], us: Column, step: int, measured: str, reference: str, reach: int = 4) -> DataFrame:
    """Steps by which measured light lags the reference: the circular shift of highest correlation of the daily cycles."""
    cycle = slot_means(steps, keys, us, step, [measured, reference])
    return best_lag(cycle, keys, "slot", measured, reference, list(range(-reach, reach + 1)), 86_400_000_000 // step)


def record_summary(steps: DataFrame, keys: Sequence[str], us: str, value: str, light: str, lon: str, lat: str) -> DataFrame:
    """Values, first and last step, and the best clock offset of each tower."""
    sizes = steps.groupBy(*keys).agg(F.count(value).alias("n_values"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    return sizes.join(offset_search(steps, keys, us, light, lon, lat), list(keys), "left")
