"""Selections and the rows that domain rules refuse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.spatial import in_box
from fieldloom.operators.joins import request_order


def select_sites(table: DataFrame, key: str = "site_id", *, ids: Sequence[int] | None = None, box: tuple[float, float, float, float] | None = None, where: Column | None = None, n_random: int | None = None, seed: int = 0) -> DataFrame:
    """Ids, then box, then predicate, then a random sample. Ids keep the order of the request; a sample is by id.

    The sample takes the rows whose digest of seed and id is least, so it doesn't depend on partitions.
    """
    out = request_order(table, ids, key) if ids is not None else table
    if box is not None:
        out = out.where(in_box(F.col("lon"), F.col("lat"), *box))
    if where is not None:
        out = out.where(F.when(where.isNull(), F.raise_error(F.lit("the predicate is missing for a row"))).otherwise(where))
    if n_random is not None:
        out = out.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n_random)
    return out


def passing(rows: DataFrame, flag: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose quality flag passes, and the counts of kept and dropped rows."""
    ok = F.col(flag).eqNullSafe(F.lit(value))
    return rows.where(ok), rows.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def observations(rows: DataFrame, *, sources: Sequence[str] | None = None, sites: Sequence[int] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sources, sites and an inclusive span of time, whose ends may be a year, month or day; static rows have no time."""
    out = rows
    if sources is not None:
        out = out.where(F.col("source").isin(list(sources)))
    if sites is not None:
        out = out.where(F.col("site").isin(list(sites)))
    time = F.col("time")
    if start is not None:
        out = out.where(time.isNull() | (time >= F.lit(period(start)[0]).cast("timestamp_ntz")))
    if end is not None:
        out = out.where(time.isNull() | (time < F.lit(period(end)[1]).cast("timestamp_ntz")))
    return out


def period(text: str) -> tuple[str, str]:
    """First instant of a year, month, day or second, and the first instant after it."""
    import pandas as pd

    unit = {4: "Y", 7: "M", 10: "D"}.get(len(text), "s")
    p = pd.Period(text, unit)
    return str(p.start_time), str((p + 1).start_time)


def out_of_domain(rows: DataFrame, keys: Sequence[str], domains: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """One row for each value outside its closed domain or not finite: ``keys, variable, value``."""
    # a single pass over the table: the offending variables of a row are an array
    bad = []
    for name, (low, high) in domains.items():
        v = F.col(name).cast("double")
        off = F.isnan(v) | (F.abs(v) == float("inf"))
        if low is not None:
            off |= v < low
        if high is not None:
            off |= v > high
        bad.append(F.when(off, F.struct(F.lit(name).alias("variable"), v.alias("value"))))
    return rows.select(*keys, F.explode(F.array_compact(F.array(*bad))).alias("__bad")).select(*keys, "__bad.variable", "__bad.value")


def in_simplex(values: Column, tolerance: float = 1e-10) -> Column:
    """Whether an array has no negative entry and sums to one."""
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.forall(values, lambda x: x >= 0) & (F.abs(total - 1) <= tolerance)


def in_interval(value: Column, low: float | None, high: float | None, *, closed: bool = True) -> Column:
    ok = value.isNotNull() & ~F.isnan(value)
    if low is not None:
        ok &= value >= low if closed else value > low
    if high is not None:
        ok &= value <= high if closed else value < high
    return ok


def well_measured(steps: DataFrame, windows_keys: Sequence[str], measured: Column, least: float, value: str) -> DataFrame:
    """Mean of each window of which at least a share of the steps was measured, and that share."""
    share = F.avg(measured.cast("double"))
    return steps.groupBy(*windows_keys).agg(F.avg(value).alias("mean"), share.alias("measured")).where(F.col("measured") >= least)
