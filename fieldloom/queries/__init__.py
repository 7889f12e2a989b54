"""Registered queries: each operator on the carrier tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query by its name, with the SQL that gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def rounded(frame: DataFrame, places: int = 6) -> DataFrame:
    """Floating-point columns rounded, as sums differ in their last digits with the order of rows."""
    return frame.select(*(F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in frame.dtypes))


def uniform_sql(seed: int, *keys: str) -> str:
    """``ensemble.uniform`` in SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::bigint / 4503599627370496.0)"


def normal_sql(seed: int, *keys: str) -> str:
    """``ensemble.normal`` in SQL."""
    return f"(sqrt(-2 * ln(1 - {uniform_sql(seed, *keys)})) * cos(2 * pi() * {uniform_sql(seed + 1_000_003, *keys)}))"


def r(column: Column, name: str, places: int = 6) -> Column:
    return F.round(column, places).alias(name)
