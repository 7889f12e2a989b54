"""Nearest neighbours within a radius, and the projected bounds of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.spatial import equal_area


def nearest_within(points: DataFrame, sites: DataFrame, key: str, site: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """The nearest site within a radius of each point, with its distance; of equal ones the least site.

    Sites are put into the square cells of a grid as wide as the radius that a point in reach could be in (nine), so the
    join is an equi-join on the cell. Points without a site in reach keep NULLs.
    """
    cell = [F.floor(F.col(c) / radius) for c in (x, y)]
    near = sites.select(F.col(site), F.col(x).alias("__x"), F.col(y).alias("__y"), *(c.alias(n) for c, n in zip(cell, ("__i0", "__j0"), strict=True)))
    near = near.withColumn("__i", F.explode(F.sequence(F.col("__i0") - 1, F.col("__i0") + 1))).withColumn("__j", F.explode(F.sequence(F.col("__j0") - 1, F.col("__j0") + 1)))
    asked = points.withColumns({"__i": cell[0], "__j": cell[1]})
    distance = F.sqrt(F.pow(F.col(x) - F.col("__x"), 2) + F.pow(F.col(y) - F.col("__y"), 2))
    met = asked.join(near, ["__i", "__j"]).withColumn("distance", distance).where(F.col("distance") <= radius)
    best = met.groupBy(key).agg(F.min(F.struct("distance", site)).alias("__b"))
    return points.join(best, key, "left").select(*points.columns, F.col(f"__b.{site}").alias(site), F.col("__b.distance").alias("distance"))


def projected_bounds(spark, box: tuple[float, float, float, float], lon0: float, lat0: float, per_edge: int = 256) -> DataFrame:
    """Least and greatest easting and northing of a box whose edges are sampled."""
    west, south, east, north = box
    k = F.col("id") / float(per_edge)
    edge = spark.range(per_edge + 1)
    sides = [(F.lit(west) + k * (east - west), F.lit(south)), (F.lit(west) + k * (east - west), F.lit(north)), (F.lit(west), F.lit(south) + k * (north - south)), (F.lit(east), F.lit(south) + k * (north - south))]
    out = None
    for lon, lat in sides:
        x, y = equal_area(lon.cast("double"), lat.cast("double"), lon0, lat0)
        one = edge.select(x.alias("x"), y.alias("y"))
        out = one if out is None else out.union(one)
    return out.agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
