"""Session settings that the panel semantics need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Stamps are naive UTC; arithmetic overflows and bad casts raise.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}


def panel_session(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return panel_session(spark).read.parquet(f"{directory}/{name}.parquet")
