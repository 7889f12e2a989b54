"""Dense rectangles, stacked batch dims, and other changes of shape of long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.staging import Workspace


def dense(rows: DataFrame, axes: Sequence[DataFrame], values: Sequence[str]) -> DataFrame:
    """Every combination of the axes' labels, with NULL values where there is no row; a repeated key fails the query."""
    spine = axes[0]
    for axis in axes[1:]:
        spine = spine.crossJoin(axis)
    keys = spine.columns
    once = rows.groupBy(*keys).agg(*(F.first(v).alias(v) for v in values), F.count("*").alias("__n"))
    ok = F.when(F.coalesce("__n", F.lit(0)) > 1, F.raise_error(F.lit("a key of the rectangle repeats"))).otherwise(F.lit(True))
    return spine.join(once, keys, "left").where(ok).drop("__n")


def static_values(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key of which all copies agree, missing values included; differing copies fail the query."""
    same = [(F.count_distinct(v) + F.max(F.col(v).isNull().cast("int"))).alias(f"__{v}") for v in values]
    found = rows.groupBy(*keys).agg(*(F.max(v).alias(v) for v in values), *same)
    differ = F.lit(False)
    for v in values:
        differ |= F.col(f"__{v}") > 1
    ok = F.when(differ, F.raise_error(F.lit("copies of a static value differ"))).otherwise(F.lit(True))
    return found.where(ok).select(*keys, *values)


def in_ranges(frame: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows dealt by ranges of an order, with their range ``__part`` and their place ``__at`` in it, written once.

    Ranges are drawn by sampling, so dealing the rows a second time may cut them elsewhere; what needs the sums of the ranges
    and the rows must read both from here.
    """
    dealt = frame.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("__id"))
    placed = dealt.withColumns({"__part": F.shiftright("__id", 33), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    return Workspace(frame.sparkSession, "ranges").keep(placed.drop("__id"), "rows")


def numbered(frame: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows with their place, from 0, in a global order, without gathering them in one task.

    Rows are dealt by ranges of the order; a row's place is its place in its part and the rows of the parts before.
    """
    parts = in_ranges(frame, order)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return parts.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__at") + F.col("__start")).cast("long")).drop("__part", "__at", "__start")


def stack(frame: DataFrame, dims: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Batch dims as one new dim in their order, and the labels that ``unstack`` needs."""
    labels = numbered(frame.select(*dims).distinct(), dims, name)
    return frame.join(labels, list(dims)).drop(*dims), labels


def unstack(frame: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return frame.join(labels, name).drop(name)


def split_elements(frame: DataFrame, keys: Sequence[str], column: str, labels: Sequence[str]) -> DataFrame:
    """An array column as one row for each element: ``keys, variable, value`` with names ``column.label``."""
    names = F.array(*(F.lit(f"{column}.{x}") for x in labels))
    exact = F.when(F.size(column) != len(labels), F.raise_error(F.lit("an array doesn't have one value for each label"))).otherwise(F.col(column))
    return frame.select(*keys, F.posexplode(exact).alias("__i", "value")).select(*keys, F.element_at(names, F.col("__i") + 1).alias("variable"), "value")


def thin(rows: DataFrame, position: str, n_rows: int, n: int) -> DataFrame:
    """At most ``n`` rows, evenly spaced over positions 0 to ``n_rows - 1``."""
    if n >= n_rows:
        return rows
    step = (n_rows - 1) / max(1, n - 1)
    # positions that rint(k * step) hits for some k
    k = F.rint(F.col(position) / step)
    hit = F.lit(False)
    for d in (-1, 0, 1):
        hit |= ((k + d).between(0, n - 1)) & (F.rint((k + d) * step) == F.col(position))
    return rows.where(hit)


def vertical_split(table: DataFrame, key: Sequence[str], parts: Sequence[Sequence[str]]) -> list[DataFrame]:
    """A table as several, each with the key."""
    return [table.select(*key, *columns) for columns in parts]


def replace_values(held: DataFrame, values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Other values for the same keys; a key on one side only fails the query."""
    other = values.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__b"))
    both = held.withColumn("__a", F.lit(True)).join(other, list(keys), "full")
    ok = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("the keys of the new values differ"))).otherwise(F.lit(True))
    return both.where(ok).withColumn(value, F.col("__new")).select(*held.columns)


def run_table(samples: int, crossed: Sequence[DataFrame], sites: DataFrame) -> DataFrame:
    """Every run: samples by crossed labels by sites, numbered in that order."""
    spark = sites.sparkSession
    frame = spark.range(samples).withColumnRenamed("id", "sample")
    for labels in crossed:
        frame = frame.crossJoin(labels)
    frame = frame.crossJoin(sites)
    return numbered(frame, frame.columns, "run")


def first_finite(draws: DataFrame, order: str, density: Column, n: int) -> DataFrame:
    """The first ``n`` draws with a finite density."""
    finite = density.isNotNull() & ~F.isnan(density) & (F.abs(density) != float("inf"))
    return draws.where(finite).orderBy(order).limit(n)
