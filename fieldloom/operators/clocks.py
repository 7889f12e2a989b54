"""Recovery of a clock's offset from measured light."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.spatial import solar_toa


def offset_search(steps: DataFrame, keys: Sequence[str], us: str, measured: str, lon: str, lat: str, limit_hours: int = 12) -> DataFrame:
    """Best and second-best UTC offset, by half hours, of each key: least RMSE of light against the solar formula.

    Each row meets its 49 candidates inside its task, where partial sums reduce them to one row a key and candidate; only
    those are shuffled. One formula over a generated column stays within generated code, as 49 formulas wouldn't.
    """
    tries = steps.select(*keys, us, measured, lon, lat, F.explode(F.sequence(F.lit(-2 * limit_hours), F.lit(2 * limit_hours))).alias("__k"))
    error = F.col(measured) - solar_toa(F.col(us) + F.col("__k").cast("long") * 1_800_000_000, F.col(lon), F.col(lat))
    per = tries.groupBy(*keys, "__k").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    ranked = F.array_sort(F.collect_list(F.struct("rmse", (F.col("__k") / 2).alias("offset"))))  # 49 of them
    out = per.groupBy(*keys).agg(ranked.alias("__r"))
    best, following = F.col("__r")[0], F.col("__r")[1]
    return out.select(*keys, best["offset"].alias("best_offset"), best["rmse"].alias("best_rmse"), following["offset"].alias("next_offset"), F.try_divide(following["rmse"], best["rmse"]).alias("separation"))
