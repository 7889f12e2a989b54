"""Surveys of sources: presence, ranges and coverage by partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def column_survey(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows, missing, median, range and the number of keys with any value, for each column, in one pass."""
    figures = [
        F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.median(c).alias("median"), F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"), F.count_distinct(F.when(F.col(c).isNotNull(), F.col(key))).alias("keys_with_any"),
        ).alias(f"__{i}")
        for i, c in enumerate(columns)
    ]
    return rows.agg(*figures).select(F.explode(F.array(*(f"__{i}" for i in range(len(columns))))).alias("__s")).select("__s.*")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows and share of each value, a missing one included."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("__t")).alias("share"))


def inversions(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows on which the first isn't before the second: their number, keys, and median excess."""
    bad = rows.where(F.col(first) >= F.col(second))
    return bad.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.median(F.col(first) - F.col(second)).alias("median_excess"))


def completeness(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Whether the rows are the whole rectangle of the labels that occur, each cell once."""
    sizes = [F.count_distinct(a).alias(f"n_{a}") for a in axes]
    found = rows.agg(F.count("*").alias("rows"), F.count_distinct(*axes).alias("cells"), *sizes)
    product = F.lit(1)
    for a in axes:
        product = product * F.col(f"n_{a}")
    return found.withColumn("complete", (F.col("rows") == F.col("cells")) & (F.col("cells") == product))


def profile_integral(rows: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str, value: str, factor: float) -> DataFrame:
    """Sum of a value over the thickness of each layer; missing if any layer's value is."""
    w = Window.partitionBy(*keys).orderBy(*order)
    layer = rows.withColumn("__d", F.col(depth) - F.coalesce(F.lag(depth).over(w), F.lit(0)))
    total = F.sum(F.col("__d") * F.col(value) * factor)
    return layer.groupBy(*keys).agg(F.when(F.count(value) == F.count("*"), total).alias("integral"))


def kept_by_month(days: DataFrame, day: str) -> DataFrame:
    """Days held and possible in each month."""
    found = days.groupBy(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(F.last_day(day)).alias("possible")).agg(F.count_distinct(day).alias("held"))
    return found.select("year", "month", "held", "possible", (F.col("held") / F.col("possible")).alias("share"))


def files_survey(files: DataFrame, template: str, groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Files of a listing by the groups of a path template, and the paths that are off the template."""
    on = F.col("path").rlike(template)
    named = files.where(on).select("path", "length", *(F.regexp_extract("path", template, i + 1).alias(g) for i, g in enumerate(groups)))
    return named.groupBy(*groups).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")), files.where(~on).select("path")
