"""Observation operators: from model output to a prediction of each observation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.time import micros
from fieldloom.operators import windows as W

#: Factors between units that are known without a units library: (from, to).
UNITS = {("g m-2", "kg m-2"): 1e-3, ("kg m-2", "g m-2"): 1e3, ("g m-2", "Mg ha-1"): 1e-2, ("Mg ha-1", "g m-2"): 1e2, ("percent", "1"): 1e-2, ("1", "percent"): 1e2}
#: Grams of carbon a square meter and day as micromoles a square meter and second.
UMOL_PER_GRAM_DAY = 1e6 / (12.011 * 86_400)


def unit_factor(have: str, want: str) -> float:
    if have == want:
        return 1.0
    if (have, want) not in UNITS:
        raise ValueError(f"no factor from {have!r} to {want!r} is known")
    return UNITS[have, want]


def _for_each_run(labels: DataFrame, output: DataFrame, batch: list[str]) -> DataFrame:
    """Each label of a site for every run of that site: an equi-join on the site, so runs may be as many as they are."""
    return labels.join(output.select(*batch, "site").distinct(), "site") if batch else labels


@dataclass(frozen=True)
class SelectTimestep:
    """The value of the step that holds each observation's stamp."""

    variable: str

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
        labels = _for_each_run(observed.select("site", "time"), output, batch)
        steps = output.select(*batch, "site", "timestep_start", F.col("time").alias("timestep_end"), F.col(self.variable).alias("prediction"))
        return W.as_of(labels, steps, [*batch, "site"]).select(*batch, "site", "time", "prediction")


@dataclass(frozen=True)
class ReduceOverWindows:
    """A reduction of the steps in each observation's window, optionally of a rate: a total over its step's days."""

    variable: str
    how: str
    weighted: bool = False
    rate: bool = False
    factor: float = 1.0

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
        days = (micros(F.col("time")) - micros(F.col("timestep_start"))) / 86_400e6
        value = F.col(self.variable) / days if self.rate else F.col(self.variable)
        steps = output.select(*batch, "site", "time", (value * self.factor).alias("value"), days.alias("days"))
        windows = observed.select("site", F.col("time").alias("label"), "window_start", "window_end")
        windows = _for_each_run(windows, output, batch)
        found = W.reduce_windows(steps, windows, [self.how], [*batch, "site", "label"], [*batch, "site"], weight="days" if self.weighted else None)
        return found.select(*batch, "site", F.col("label").alias("time"), F.col(self.how).alias("prediction"))


@dataclass(frozen=True)
class ReduceOverRun:
    """A reduction of a whole record, for observations without a time."""

    variable: str
    how: str
    factor: float = 1.0

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
        run = W.whole_run(output.select(*batch, "site", "time", (F.col(self.variable) * self.factor).alias("value")), [*batch, "site"], [self.how])
        return run.join(observed.select("site").distinct(), "site", "left_semi").select(*batch, "site", F.lit(None).cast("timestamp_ntz").alias("time"), F.col(self.how).alias("prediction"))


@dataclass(frozen=True)
class AverageRate:
    """The mean rate of a total over each window: its steps' rates, weighted by their lengths."""

    variable: str
    factor: float = 1.0

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
        return ReduceOverWindows(self.variable, "mean", weighted=True, rate=True, factor=self.factor).predict(output, observed, batch)


@dataclass(frozen=True)
class AbovegroundBiomass:
    """Dry biomass: wood carbon averaged over each window by step length, over the share of dry wood that is carbon."""

    carbon_fraction: float
    wood: str = "wood_carbon"

    def __post_init__(self) -> None:
        if isinstance(self.carbon_fraction, bool) or not isinstance(self.carbon_fraction, (int, float)):
            raise TypeError("the carbon fraction is a number")
        if not 0 < self.carbon_fraction < 1:
            raise ValueError("the carbon fraction is between 0 and 1")

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
        return ReduceOverWindows(self.wood, "mean", weighted=True, factor=1 / self.carbon_fraction).predict(output, observed, batch)


@dataclass(frozen=True)
class LeafAreaIndex:
    """Leaf carbon over the leaf carbon an area of leaf has, a parameter of the run and site."""

    leaf: str = "leaf_carbon"
    per_area: str = "leaf_carbon_per_area"

    def predict(self, output: DataFrame, observed: DataFrame, batch: list[str], parameters: DataFrame | None = None) -> DataFrame:
        if parameters is None:
            raise ValueError("leaf area index needs the parameter fields")
        keys = [k for k in (*batch, "site") if k in parameters.columns]
        if extra := [c for c in parameters.columns if c not in (*batch, "site", self.per_area)]:
            raise ValueError(f"the parameter has dims that the output lacks: {', '.join(extra)}")
        area = output.join(parameters, keys).withColumn("lai", F.col(self.leaf) / F.col(self.per_area))
        return SelectTimestep("lai").predict(area, observed, batch)


def predict(operators: Mapping[str, Callable], output: DataFrame, observed: DataFrame, batch: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Predictions of every source in one table; a missing one is an error unless its run failed."""
    out = None
    for source, operator in operators.items():
        own = observed.where(F.col("source") == source)
        one = operator.predict(output, own, batch).withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there is no source to predict")
    missing = F.col("prediction").isNull()
    if failed is not None:
        bad = failed.select(*batch, "site").distinct().withColumn("__failed", F.lit(True))
        out = out.join(bad, [*batch, "site"], "left")
        missing &= F.col("__failed").isNull()
    ok = F.when(missing, F.raise_error(F.lit("a prediction is missing and its run didn't fail"))).otherwise(F.lit(True))
    return out.where(ok).select("source", *batch, "site", "time", "prediction")


def contract_violations(operator, output: DataFrame, observed: DataFrame, batch: list[str]) -> DataFrame:
    """What an operator's predictions break of its contract, with the number of rows.

    One finite prediction for each run and observed label, none for others, the same whatever order or partitions its
    inputs have.
    """
    keys = [*batch, "site", "time"]
    once = operator.predict(output, observed, batch)
    wanted = _for_each_run(observed.select("site", "time").distinct(), output, batch).select(*keys)
    safe = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = safe[0]
    for c in safe[1:]:
        on &= c

    def without(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(*(F.col(k).alias(f"__{k}") for k in keys)), on, "left_anti")

    again = operator.predict(output.repartition(3), observed.repartition(2), batch)
    found = {
        "repeated": once.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"),
        "missing": without(wanted, once),
        "unknown": without(once, wanted),
        "not finite": once.where(F.isnan("prediction") | (F.abs("prediction") == float("inf"))),
        "unstable": once.select(*keys, F.round("prediction", 9).alias("p")).exceptAll(again.select(*keys, F.round("prediction", 9).alias("p"))),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = one if out is None else out.union(one)
    return out.where("n > 0")


def positions(observed: DataFrame) -> DataFrame:
    """Observations with their position in the stacked vector: by source, site and time."""
    from fieldloom.operators.reshape import numbered

    return numbered(observed, ["source", "site", "time"], "position")
