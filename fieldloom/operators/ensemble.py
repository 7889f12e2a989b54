"""Ensembles: fan-out of a simulator, failures as data, and summaries over members."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.aggregates import central, quantiles

#: Columns of every run's report.
STATUS = "status string, error string, message string"


class ModelFailure(Exception):
    """A run that the simulator refuses or can't finish: data, not an error of the job."""


#: Runs of a site that share one copy of its forcing.
CHUNK = 64


def fan_out(runs: DataFrame, simulate: Callable[[Mapping[str, float], pd.DataFrame], pd.DataFrame], forcing: DataFrame | None, keys: Sequence[str], parameters: Sequence[str], site: str, order: str, schema: str) -> DataFrame:
    """One simulation for each run, reduced where it ran.

    ``simulate(parameters, forcing of the site)`` returns rows of ``schema``; the forcing is ordered by ``order``. A
    ``ModelFailure`` gives one row with the failure and NULL outputs; any other exception fails the job after Spark's
    retries. A site's runs are dealt by their keys into chunks of about ``CHUNK``; its forcing is sent once a chunk. Runs of a
    site without forcing get an empty table.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    out_schema = ", ".join([*(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys), schema, STATUS])

    def reports(held: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        outputs, status = [], []
        for values in held[list(parameters)].to_dict("records"):
            try:
                outputs.append(simulate(values, given)[names])
                status.append(("ok", None, None))
            except ModelFailure as failure:
                outputs.append(pd.DataFrame([dict.fromkeys(names)], dtype=object))
                status.append(("failed", type(failure).__name__, str(failure)))
        run = np.repeat(np.arange(len(held)), [len(x) for x in outputs])
        own = [held[k].reset_index(drop=True).take(run).reset_index(drop=True) for k in keys]
        table = {n: [v for x in outputs for v in x[n].tolist()] for n in names}
        return pd.concat([*own, pd.DataFrame(table), pd.DataFrame([status[k] for k in run], columns=["status", "error", "message"])], axis=1)

    runs = runs.select(*dict.fromkeys([*keys, *parameters, *([site] if forcing is not None else [])]))
    if forcing is None:

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for held in batches:
                for lo in range(0, len(held), CHUNK):
                    yield reports(held.iloc[lo : lo + CHUNK], pd.DataFrame())

        return runs.mapInPandas(alone, out_schema)

    def together(held: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.drop(columns=[site, "__chunk"]).sort_values(order, kind="stable", ignore_index=True)
        return reports(held, given)

    chunks = runs.groupBy(site).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("__chunks"))
    dealt = runs.join(chunks, runs[site].eqNullSafe(chunks[site])).drop(chunks[site]).withColumn("__chunk", F.pmod(F.hash(*keys), "__chunks")).drop("__chunks")
    sent = forcing.join(chunks, site).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1))).drop("__chunks")
    return dealt.groupBy(site, "__chunk").cogroup(sent.groupBy(site, "__chunk")).applyInPandas(together, out_schema)


def failures(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    return results.where("status = 'failed'").select(*keys, "error", "message").distinct()


def failure_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each kind of failure with the number of runs it hit."""
    return failures(results, keys).groupBy("error", "message").agg(F.count("*").alias("runs"))


def validity(results: DataFrame, sample: str, outside: DataFrame | None = None) -> DataFrame:
    """Whether all sites of a sample ran, with parameters inside their domains."""
    valid = results.groupBy(sample).agg(F.bool_and(F.col("status") == "ok").alias("valid"))
    if outside is None:
        return valid
    bad = outside.select(sample).distinct().withColumn("__bad", F.lit(True))
    return valid.join(bad, sample, "left").select(sample, (F.col("valid") & F.col("__bad").isNull()).alias("valid"))


def stack_outputs(members: Mapping[int, DataFrame], sample: str = "sample") -> DataFrame:
    """Runs with different time axes as one table; a stamp that a run lacks is no row."""
    out = None
    for label, frame in members.items():
        one = frame.withColumn(sample, F.lit(label).cast("long"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("there are no runs to stack")
    return out


def summarise(field: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Mean, median, population deviation and quantiles over members, missing values skipped."""
    q = quantiles(F.col(value), levels)
    return field.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("sd"), *(q[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(levels))
    )


def coverage(predictions: DataFrame, observed: DataFrame, on: Sequence[str], masses: Sequence[float] = (0.5, 0.9), value: str = "value", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Share of observations inside the central intervals of their predictions, a column for each mass."""
    ends = {}
    for m in masses:
        lo, hi = central(F.col(prediction), m)
        ends[f"lo{round(100 * m)}"], ends[f"hi{round(100 * m)}"] = lo, hi
    bands = predictions.groupBy(*on).agg(*(c.alias(n) for n, c in ends.items()))
    both = observed.join(bands, list(on))
    inside = [F.avg(F.col(value).between(F.col(f"lo{round(100 * m)}"), F.col(f"hi{round(100 * m)}")).cast("double")).alias(f"inside{round(100 * m)}") for m in masses]
    return both.groupBy(*by).agg(F.count("*").alias("n"), *inside) if by else both.agg(F.count("*").alias("n"), *inside)


def two_level_quantiles(field: DataFrame, member: str, keys: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """Quantiles over members of each member's own means."""
    means = field.groupBy(*keys, member).agg(F.avg(value).alias("mean"))
    q = quantiles(F.col("mean"), levels)
    return means.groupBy(*keys).agg(F.count("*").alias("members"), *(q[i].alias(f"q{round(100 * p):02d}") for i, p in enumerate(levels)))


def uniform(seed: int, *keys: str):
    """A number in [0, 1) for each key: 52 bits of a digest, so it depends on neither partitions nor order, and SQL can say it."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *keys: str):
    """A standard normal for each key, from two uniforms."""
    u, v = uniform(seed, *keys), uniform(seed + 1_000_003, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
