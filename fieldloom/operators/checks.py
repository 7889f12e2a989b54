"""Data-quality assertions as queries that return the rows that break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """A check found rows; carries its name, their count and a few of them."""


def require(name: str, violations: DataFrame, remedy: str = "", shown: int = 5) -> None:
    """Raises if there are violating rows; reads only as many as it shows, and counts them then."""
    found = violations.limit(shown).collect()
    if found:
        raise ContractViolation(f"{name}: {violations.count()} violating rows, as {found}. {remedy}".strip())


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unknown_keys(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys).distinct().join(table.select(*keys), list(keys), "left_anti")


def not_missing_together(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(F.col(a).isNull() != F.col(b).isNull())


def not_finite(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad |= F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return rows.where(bad)


def outside_classes(rows: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(list(classes)))


def never_passing(rows: DataFrame, keys: Sequence[str], passes: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_or(passes), F.lit(False)).alias("passes")).where("not passes")


def apart(rows: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Rows whose columns differ from the table's by more than a tolerance."""
    other = table.select(*keys, *(F.col(c).alias(f"table_{c}") for c in columns))
    off = F.lit(False)
    for c in columns:
        off |= F.abs(F.col(c) - F.col(f"table_{c}")) > tolerance
    return rows.join(other, list(keys)).where(off)


def missing_cells(rows: DataFrame, axes: Sequence[DataFrame]) -> DataFrame:
    """Combinations of the axes' labels that have no row."""
    spine = axes[0]
    for axis in axes[1:]:
        spine = spine.crossJoin(axis)
    return spine.join(rows.select(*spine.columns).distinct(), spine.columns, "left_anti")


def uneven_presence(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which a column is present for some rows and missing for others: ``keys, variable``."""
    mixed = [F.when((F.count(c) > 0) & (F.count(c) < F.count("*")), F.lit(c)) for c in columns]
    found = rows.groupBy(*keys).agg(F.array_compact(F.array(*mixed)).alias("__bad"))
    return found.select(*keys, F.explode("__bad").alias("variable"))


def gaps_in_stamps(rows: DataFrame, keys: Sequence[str], stamp_us: Column, step: int) -> DataFrame:
    """Stamps that don't follow the one before by exactly a step."""
    w = Window.partitionBy(*keys).orderBy("__us")
    return rows.withColumn("__us", stamp_us).withColumn("gap", F.col("__us") - F.lag("__us").over(w)).where(F.col("gap") != step).drop("__us")


def not_increasing(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).where(F.col(value) <= F.col("previous"))


def not_a_permutation(rows: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Groups whose ranks aren't 1 to n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(rank).alias("lowest"), F.max(rank).alias("highest"), F.count_distinct(rank).alias("distinct_ranks")).where(
        "lowest <> 1 or highest <> n or distinct_ranks <> n"
    )


def not_a_function(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys that map to several values, a missing one counted as a value."""
    return rows.groupBy(*key).agg((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n")).where("n > 1")


def not_constant(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups of copies that differ in a column, a missing value counted."""
    return not_a_function(rows.withColumn("__copy", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})), keys, "__copy")


def missing_ids(ids: DataFrame, key: str) -> DataFrame:
    """Whole numbers between the least and the highest id that no row has."""
    span = ids.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias(key)).join(ids, key, "left_anti")


def unexpected_count(rows: DataFrame, expected: int) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).withColumn("expected", F.lit(expected))


def against_record(measured: Mapping[str, object], recorded: Mapping[str, object]) -> dict[str, tuple[object, object]]:
    """Figures of a survey that differ from the recorded ones."""
    return {k: (measured.get(k), recorded.get(k)) for k in sorted({*measured, *recorded}) if measured.get(k) != recorded.get(k)}


def round_trip(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, with the side."""
    return before.exceptAll(after).withColumn("side", F.lit("lost")).unionByName(after.exceptAll(before).withColumn("side", F.lit("gained")))
