"""Checked writes: nothing is published before it was read back and found equal."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.checks import ContractViolation, round_trip


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def checked_write(frames: Mapping[str, DataFrame], partition_by: Mapping[str, Sequence[str]] | None = None) -> None:
    """Writes each frame beside its path, reads it back, and renames all only when all are equal to what was written.

    What a failed check leaves keeps its ``.partial`` name for a look; an earlier table at the path stays until the rename.
    """
    staged: list[tuple[SparkSession, str, str]] = []
    for path, frame in frames.items():
        spark, part = frame.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.partial"
        writer = frame.write.option("compression", "zstd")
        keys = (partition_by or {}).get(path)
        (writer.partitionBy(*keys) if keys else writer).parquet(part)
        back = spark.read.schema(frame.schema).parquet(part).select(*frame.columns)
        if found := round_trip(frame, back).limit(3).collect():
            raise ContractViolation(f"{part} isn't what was written: {found}")
        staged.append((spark, part, path))
    for spark, part, path in staged:
        files, to = _path(spark, path)
        if files.exists(to):
            files.delete(to, True)
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(part), to):
            raise OSError(f"{part} couldn't be renamed to {path}")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file of the driver's, in whatever store the path names."""
    files, to = _path(spark, path)
    out = files.create(to, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def netcdf3(values: Mapping[str, float], fill: float) -> bytes:
    """A classic netCDF file of scalars, each with its fill value, by the published layout."""
    import struct

    def text(x: str) -> bytes:
        data = x.encode()
        return struct.pack(">i", len(data)) + data + bytes(-len(data) % 4)

    attribute = struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iid", 6, 1, fill)
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + text("time") + struct.pack(">i", 1) + bytes(8)
    heads = [text(n) + struct.pack(">ii", 1, 0) + attribute + struct.pack(">ii", 6, 8) for n in values]
    begin = len(head) + 8 + sum(len(h) + 4 for h in heads)
    body = b"".join(h + struct.pack(">i", begin + 8 * i) for i, h in enumerate(heads))
    return head + struct.pack(">ii", 11, len(heads)) + body + b"".join(struct.pack(">d", v) for v in values.values())


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Size and md5 of each file below a folder."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(root)
    return files.select("path", "length", F.md5("content").alias("md5"))


def provenance(spark: SparkSession, path: str, inputs: DataFrame, settings: Mapping[str, object]) -> None:
    """A JSON record of settings and input digests beside a table."""
    rows = [{"path": r["path"], "length": r["length"], "md5": r["md5"]} for r in inputs.orderBy("path").toLocalIterator()]
    text = json.dumps({"settings": dict(settings), "inputs": rows}, sort_keys=True, indent=1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def with_flags(frame: DataFrame, columns: Sequence[str], missing: int = -1) -> DataFrame:
    """Flags as the files hold them: a missing one is ``missing``."""
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(missing).cast(frame.schema[c].dataType)) for c in columns})
