"""Joins that check a size before they broadcast, and filters of hashes; ``Workspace`` holds tables of a run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldloom.staging import Workspace, shared_root

__all__ = ["Workspace", "bounded", "local_table", "shared_root", "without", "bitmap", "in_bitmap"]


#: Rows of a batch that goes to a Python worker: whole texts stand in it, in the engine's memory and in the worker's.
BATCH_ROWS = 2_000


def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """The session with batches of at most ``rows`` rows for Python workers; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return spark


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, as a table that stands in the plan.

    From a list Spark makes an RDD of Python objects, which starts a second pool of Python workers on the executors.
    """
    fields = StructType.fromDDL(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    kinds = to_arrow_schema(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds), fields)


#: Ids that a broadcast of keys may hold (8 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 2_000_000


def without(frame: DataFrame, keys: DataFrame, key: str, bound: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``frame`` whose ``key`` isn't among ``keys``; broadcasts the keys only when they were counted and are few."""
    if keys.limit(bound + 1).count() <= bound:
        keys = F.broadcast(keys)
    return frame.join(keys, key, "left_anti")


#: Bits of the largest filter of hashes that is sent to every task.
FILTER_BITS = 1 << 26


def bitmap(hashes: DataFrame, column: str, most: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of a column of hashes, gathered by an OR over all tasks: sixteen bits a row, up to ``most`` in all.

    Beyond that it lets more through, which costs time alone.
    """
    size = min(most, 1 << max(10, (16 * hashes.count()).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(size - 1))
    bits = hashes.select(F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast(`{column}` & 31L as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # size / 32 rows at most
    out = np.zeros(size // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def in_bitmap(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which signed hashes the bitmap may hold."""
    slot = hashes & np.int64(32 * len(held) - 1)
    return (held[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
