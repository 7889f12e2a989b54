"""Declared schemas of the panel's tables. Spec attributes stand in the columns' metadata."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class TimeStructure(Enum):
    STATIC = "static"
    ANNUAL = "annual"
    DATED = "dated"


def _schema(*columns: tuple[str, T.DataType, bool, dict]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable, meta) for n, t, nullable, meta in columns])


def _c(name: str, kind: T.DataType, nullable: bool = False, **meta: object) -> tuple[str, T.DataType, bool, dict]:
    return name, kind, nullable, meta


INT, LONG, DOUBLE, TEXT, BYTE, STAMP = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.ByteType(), T.TimestampNTZType()

SITES = _schema(
    _c("site_id", INT), _c("lon", DOUBLE, units="degrees_east"), _c("lat", DOUBLE, units="degrees_north"), _c("lon_index", INT), _c("lat_index", INT), _c("site_name", TEXT), _c("site_order", INT),
    _c("cluster", BYTE), _c("landcover", BYTE), _c("ameriflux_site_id", TEXT),
)
SITE_LABELS = _schema(_c("site_id", INT), _c("label", TEXT))
OBSERVATIONS = _schema(
    _c("source", TEXT), _c("site", INT), _c("time", STAMP, True), _c("window_start", STAMP, True), _c("window_end", STAMP, True), _c("value", DOUBLE, True), _c("standard_deviation", DOUBLE, True)
)
DRIVER_VARIABLES = ("tair", "tsoil", "par", "precip", "vpd", "vpd_soil", "vpress", "wspd")
#: Columns of the driver text files in their order (fixed values).
DRIVER_FILE = ("loc", "year", "day", "time", "length", *DRIVER_VARIABLES, "soil_wetness")
INITIAL_VARIABLES = ("AbvGrndWood", "wood_carbon_content", "leaf_carbon_content", "soil_organic_carbon_content", "SoilMoistFrac")


@dataclass(frozen=True)
class ConstraintSpec:
    """One source of dated, annual or static observations: its raw columns in order, and what they mean."""

    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    structure: TimeStructure
    units: str
    value: str
    deviation: str
    flag: tuple[str, str] | None = None
    missing: str = "NA"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, True, {"units": self.units} if n in (self.value, self.deviation) else {}) for n, t in self.columns])


#: Registered sources, with the raw columns in the order of their files (fixed values).
CONSTRAINTS = {
    s.name: s
    for s in (
        ConstraintSpec("landtrendr_aboveground_biomass", (("site_id", INT), ("year", INT), ("agb_mean", DOUBLE), ("agb_sd", DOUBLE)), TimeStructure.ANNUAL, "Mg ha-1", "agb_mean", "agb_sd"),
        ConstraintSpec("gedi_aboveground_biomass", (("year", INT), ("site_id", INT), ("agb", DOUBLE), ("sd", DOUBLE)), TimeStructure.ANNUAL, "Mg ha-1", "agb", "sd"),
        ConstraintSpec(
            "modis_leaf_area_index", (("date", TEXT), ("site_id", INT), ("lat", DOUBLE), ("lon", DOUBLE), ("lai", DOUBLE), ("sd", DOUBLE), ("qc", TEXT)), TimeStructure.DATED, "m2 m-2", "lai", "sd", ("qc", "000")
        ),
        ConstraintSpec("smap_soil_moisture", (("date", TEXT), ("site_id", INT), ("lat", DOUBLE), ("lon", DOUBLE), ("smp", DOUBLE), ("sd", DOUBLE)), TimeStructure.DATED, "percent", "smp", "sd"),
        ConstraintSpec("soilgrids_soil_organic_carbon", (("site_id", INT), ("soc", DOUBLE), ("sd", DOUBLE), ("year", INT)), TimeStructure.STATIC, "Mg ha-1", "soc", "sd"),
    )
}
