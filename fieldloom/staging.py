"""Tables of a run in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set by ``setCheckpointDir``; an error where neither is set on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: steps are written to a folder that the driver and all executors share")
        # one process, so its folder is shared
        spark.sparkContext.setCheckpointDir("file:///tmp/fieldloom")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


class Workspace:
    """Parquet tables of one run. They cut lineage: a lost executor costs the tasks it ran, never the steps before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame, written and to be read again; shuffle files of the write go at once, not with the driver's garbage."""
        to = f"{self.path}/{name}"
        held = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            frame.write.mode("overwrite").parquet(to)
        finally:
            self.spark.conf.unset(CLEANUP) if held is None else self.spark.conf.set(CLEANUP, held)
        return self.spark.read.schema(frame.schema).parquet(to)

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(conf).delete(path, True)
