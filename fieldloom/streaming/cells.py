"""Right-closed cells over a stream of steps, an extension beyond batch panels.

``window`` is left-closed, so stamps move back by a microsecond and its end is the cell's right edge. Cells close when the
watermark passes their end; steps later than that are dropped by the engine and seen in its metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.aggregates import present, reduction
from fieldloom.session import panel_session

_LENGTHS = {"D": "days", "h": "hours", "min": "minutes"}


def cell_length(freq: str) -> str:
    for suffix, name in _LENGTHS.items():
        if freq.endswith(suffix):
            return f"{int(freq[: -len(suffix)] or 1)} {name}"
    raise ValueError(f"{freq!r} is no fixed cell length")


def stream_cells(steps: DataFrame, keys: Sequence[str], time: str, value: str, freq: str, how: str, late: str = "1 hour") -> DataFrame:
    """Gap-aware aggregate of each key and cell, emitted once the watermark has passed it."""
    at = (F.col(time).cast("timestamp") - F.expr("interval 1 microsecond")).alias("__at")
    marked = steps.select(*keys, F.col(time), present(F.col(value).cast("double")).alias(value), at).withWatermark("__at", late)
    found = marked.groupBy(*keys, F.window("__at", cell_length(freq))).agg(reduction(how, F.col(value), F.col(time)).alias(how), F.count("*").alias("n_steps"), F.count(value).alias("n_present"))
    return found.select(*keys, F.col("window.end").cast("timestamp_ntz").alias("cell"), how, "n_steps", "n_present")


def run_once(spark: SparkSession, path: str, keys: Sequence[str], time: str, value: str, freq: str, how: str) -> DataFrame:
    """All cells of the files that are there now, from a stream that ends with them (complete output, exactly once)."""
    import uuid

    from fieldloom.staging import shared_root

    panel_session(spark)
    schema = spark.read.parquet(path).schema
    place = f"{shared_root(spark)}/cells-{uuid.uuid4().hex}"
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    cells = stream_cells(source, keys, time, value, freq, how)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/{epoch}")

    run = cells.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    # a complete output replaces the ones before; a stream ends with one that had data
    last = max(int(x) for x in _children(spark, f"{place}/out"))
    return spark.read.parquet(f"{place}/out/{last}")


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def _is_folder(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.getFileStatus(at).isDirectory()


def _children(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(at)]
