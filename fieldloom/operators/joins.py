"""Joins whose key sets are part of the contract: an unmatched or repeated key is an error or a reported row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(keys: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Many-to-one join in which every key must match; a key without a match fails the query that reads its row."""
    held = table.withColumn("__held", F.lit(True))
    joined = keys.join(held, list(on), "left")
    found = F.when(F.col("__held").isNull(), F.raise_error(F.concat(F.lit("no row for key "), F.concat_ws(",", *(F.col(k).cast("string") for k in on))))).otherwise(F.lit(True))
    return joined.where(found).drop("__held")


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which keys are unique on both sides; a repeated key fails the query."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))

    def unique(frame: DataFrame, side: str) -> DataFrame:
        ok = F.when(n > 1, F.raise_error(F.lit(f"a key repeats on the {side}"))).otherwise(F.lit(True))
        return frame.withColumn("__ok", ok).where("__ok").drop("__ok")

    return unique(left, "left").join(unique(right, "right"), list(on), "left")


def request_order(table: DataFrame, ids: Sequence[int], key: str) -> DataFrame:
    """The rows that are asked for, with the position of the request; repeats are answered twice."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"position int, {key} {table.schema[key].dataType.simpleString()}")
    return lookup(F.broadcast(asked), table, [key])


def cascade(rows: DataFrame, key: str, bases: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Entity resolution by bases in order: the first base (``key, match``, one row a key) that has a match wins.

    Returns ``rows`` with ``match`` and ``basis``; both are NULL where no base matches.
    """
    out, found, named = rows, F.lit(None), F.lit(None).cast("string")
    for i, (_, base) in enumerate(bases):
        out = out.join(base.select(key, F.col("match").alias(f"__m{i}")), key, "left")
    for i, (name, _) in reversed(list(enumerate(bases))):
        found, named = F.coalesce(F.col(f"__m{i}"), found), F.when(F.col(f"__m{i}").isNotNull(), name).otherwise(named)
    return out.select(*rows.columns, found.alias("match"), named.alias("basis"))


def first_owner(entries: DataFrame, cell: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first entry of each cell by an order that ends in a unique column: an aggregation, so cells of any size."""
    rest = [c for c in entries.columns if c not in cell]
    keyed = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    ranked = F.struct(*keyed, *rest)
    return entries.groupBy(*cell).agg(F.min(ranked).alias("__first")).select(*cell, *(F.col("__first")[c].alias(c) for c in rest))


def zip_or_cross(left: DataFrame, right: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Ensemble join: shared batch dims pair equal labels, whose sets must be the same; without one, all combinations.

    A label that only one side has fails the query. A cross product is taken only as asked for by disjoint dims, and the
    smaller side of it is then an ensemble of declared size.
    """
    shared = [d for d in dims if d in left.columns and d in right.columns]
    if not shared:
        return left.crossJoin(right)
    labels_l, labels_r = left.select(*shared).distinct().withColumn("__l", F.lit(1)), right.select(*shared).distinct().withColumn("__r", F.lit(1))
    bad = labels_l.join(labels_r, shared, "full").where("__l is null or __r is null").agg(F.count("*").alias("__bad"))
    same = F.when(F.col("__bad") > 0, F.raise_error(F.lit(f"labels of {', '.join(shared)} differ"))).otherwise(F.lit(True))
    return left.join(right, shared).crossJoin(F.broadcast(bad)).where(same).drop("__bad")


def coverage(wanted: DataFrame, held: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the ``violation`` that each is."""
    a, b = wanted.select(*on).distinct(), held.select(*on).distinct()
    return a.join(b, list(on), "left_anti").withColumn("violation", F.lit("missing")).unionByName(b.join(a, list(on), "left_anti").withColumn("violation", F.lit("unknown")))


def next_period(rows: DataFrame, keys: Sequence[str], day: str, value: str, lag: int = 1) -> DataFrame:
    """Pairs of a day's value and the value ``lag`` days later."""
    later = rows.select(*keys, F.date_sub(F.col(day), lag).alias(day), F.col(value).alias(f"next_{value}"))
    return rows.select(*keys, day, value).join(later, [*keys, day])


def primary_choice(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str, reason: Column) -> DataFrame:
    """The best row of each group with the reason it won and the names of those it beat, in rank order."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(w)).withColumn("__next", F.lead(F.struct(*rows.columns)).over(w))
    others = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__rank") > 1, F.struct("__rank", F.col(name).cast("string").alias("n"))))), lambda x: x["n"]), ",")
    losers = ranked.groupBy(*group).agg(others.alias("losers"))
    return ranked.where("__rank = 1").withColumn("reason", reason).drop("__rank", "__next").join(losers, list(group))
