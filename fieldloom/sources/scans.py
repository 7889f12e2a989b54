"""Scans of the panel's file formats. Nothing is inferred; a file off its template fails or is reported."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.time import stamp
from fieldloom.operators.reshape import static_values
from fieldloom.sources import schemas as S

_NEVER = "\u0001"  # no field of a file is this, so nothing is read as missing by its text


def read_table(spark: SparkSession, path: str, schema: T.StructType, *, missing: str | None = None, separator: str = ",", header: bool = True) -> DataFrame:
    """A delimited file (gzipped too) with an exact header and declared types; a bad field fails the query.

    Integers are read wide and narrowed, so one that doesn't fit fails as well.
    """
    wide = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) else f.dataType, True) for f in schema])
    reader = spark.read.schema(wide).options(header=header, sep=separator, mode="FAILFAST", enforceSchema=False, nullValue=missing if missing is not None else _NEVER, emptyValue="")
    return reader.csv(path).select(*(_narrowed(f) for f in schema))


def _narrowed(f: T.StructField) -> Column:
    value = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    if isinstance(f.dataType, T.StringType) and not f.nullable:
        value = F.coalesce(value, F.lit(""))
    return value.cast(f.dataType).alias(f.name, metadata=f.metadata)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The site table; the name ``NA`` is a name, and an empty one is absent."""
    return read_table(spark, path, S.SITES)


def site_labels(spark: SparkSession, path: str, site: str, label: str, classes: Sequence[str]) -> DataFrame:
    """``site_id, label`` of labelled sites; a label outside the classes fails the query."""
    raw = read_table(spark, path, T.StructType([T.StructField(site, T.IntegerType()), T.StructField(label, T.StringType())]))
    held = raw.select(F.col(site).alias("site_id"), F.col(label).alias("label")).where("label is not null and label <> ''")
    ok = F.when(~F.col("label").isin(list(classes)), F.raise_error(F.concat(F.lit("no class is "), F.col("label")))).otherwise(F.lit(True))
    return held.where(ok)


def constraint(spark: SparkSession, path: str, spec: S.ConstraintSpec) -> DataFrame:
    """Observations of a source in the long schema: quality filter, times and windows by its structure, gaps dropped."""
    raw = read_table(spark, path, spec.schema, missing=spec.missing)
    if spec.flag:
        raw = raw.where(F.col(spec.flag[0]).eqNullSafe(spec.flag[1]))
    nothing = F.lit(None).cast("timestamp_ntz")
    time = start = end = nothing
    if spec.structure is S.TimeStructure.ANNUAL:
        time = start = F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp_ntz")
        end = F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    elif spec.structure is S.TimeStructure.DATED:
        time = F.to_date("date", "yyyy-MM-dd").cast("timestamp_ntz")
    else:
        raw = static_values(raw, ["site_id"], [spec.value, spec.deviation])
    value, deviation = F.col(spec.value), F.col(spec.deviation)
    together = F.when(value.isNull() != deviation.isNull(), F.raise_error(F.lit("a value and its deviation aren't missing together"))).otherwise(value.isNotNull())
    return raw.where(together).select(
        F.lit(spec.name).alias("source"), F.col("site_id").alias("site"), time.alias("time"), start.alias("window_start"), end.alias("window_end"), value.alias("value"), deviation.alias("standard_deviation")
    )


#: Name of a tower's file: tower, resolution, first and last year, version.
FULLSET = r"AMF_([^_/]+)_FLUXNET_FULLSET_(HH|HR)_(\d{4})-(\d{4})_([^/]+)\.csv$"
FILL = -9999.0


#: What writers of local paths don't agree on.
_SLASHES = r"^([A-Za-z0-9]+):/+"
#: Files whose headers are read to the driver at most (some kilobytes each).
HEADERS = 20_000


def _first_lines(spark: SparkSession, root: str, glob: str) -> list[tuple[str, str]]:
    """Path and first line of every file below a folder whose name fits; more than ``HEADERS`` are refused."""
    import fnmatch

    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = [], files.listFiles(top, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if not fnmatch.fnmatch(path.getName(), glob):
            continue
        if len(found) >= HEADERS:
            raise ValueError(f"{root} holds more than {HEADERS} files; scan its parts")
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(path), "UTF-8"))
        try:
            found.append((re.sub(_SLASHES, r"\1:/", path.toUri().toString()), reader.readLine() or ""))
        finally:
            reader.close()
    return found


def fullset(spark: SparkSession, root: str, estimates: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Steps of all half-hourly and hourly tower files below a folder, on their regular axes.

    Files differ in their columns, so each header names what is read; lacking columns are missing. The fill value is
    missing. Steps must be whole and follow each other without a gap, which ``operators.checks.gaps_in_stamps`` reports.
    """
    wanted = [*(c for e in estimates for c in (f"NEE_{e}", f"NEE_{e}_QC", f"NEE_{e}_RANDUNC", f"NEE_{e}_JOINTUNC")), *extra]
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter="AMF_*_FLUXNET_FULLSET_*.csv").text(root).select(F.regexp_replace("_metadata.file_path", _SLASHES, "$1:/").alias("file"), "value")
    head = spark.createDataFrame(_first_lines(spark, root, "AMF_*_FLUXNET_FULLSET_*.csv"), "file string, header string").select("file", F.split("header", ",").alias("header"))
    rows = lines.where(~F.col("value").startswith("TIMESTAMP_START") & (F.trim("value") != "")).select("file", F.split("value", ",").alias("cells"))
    joined = rows.join(F.broadcast(head), "file")  # HEADERS files at most

    def number(name: str) -> Column:
        place = F.array_position("header", name)
        v = F.try_element_at("cells", place.cast("int")).cast("double")
        return F.when(place > 0, F.when(v != FILL, v)).alias(name)

    def at(name: str) -> Column:
        return F.to_timestamp(F.element_at("cells", F.array_position("header", name).cast("int")), "yyyyMMddHHmm").cast("timestamp_ntz")

    parts = [F.regexp_extract("file", FULLSET, k) for k in (1, 2, 5)]
    return joined.select(parts[0].alias("tower"), parts[1].alias("resolution"), parts[2].alias("version"), at("TIMESTAMP_START").alias("timestep_start"), at("TIMESTAMP_END").alias("time"), *(number(c) for c in wanted))


#: Path of a driver file: site and member.
DRIVER_PATH = r"ERA5_(\d+)_(\d+)/ERA5\.(\d+)\.[^/]*\.clim$"


def drivers(spark: SparkSession, root: str, sites: Sequence[int] | None = None, members: Sequence[int] | None = None) -> DataFrame:
    """Forcing of all driver files below a folder: one row a step, labelled by its end; members count from 0."""
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.clim").text(root).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") > 1)
    site, member = F.regexp_extract("file", DRIVER_PATH, 1).cast("int"), F.regexp_extract("file", DRIVER_PATH, 2).cast("long")
    whole = F.when(F.size("c") != len(S.DRIVER_FILE), F.raise_error(F.lit("a driver line doesn't have its columns"))).otherwise(F.lit(True))
    at = {n: F.element_at("c", i + 1).cast("double") for i, n in enumerate(S.DRIVER_FILE)}
    begin = F.unix_micros(F.make_date(at["year"].cast("int"), F.lit(1), F.lit(1)).cast("timestamp")) + ((at["day"] - 1) * 86_400e6 + F.rint(at["time"] * 3_600e6)).cast("long")
    length = F.rint(at["length"] * 86_400e6).cast("long")
    out = lines.where(F.col("file").rlike(DRIVER_PATH)).where(whole)
    out = out.select(site.alias("site"), (member - 1).alias("driver_member"), stamp(begin).alias("timestep_start"), stamp(begin + length).alias("time"), *(at[v].alias(v) for v in S.DRIVER_VARIABLES))
    if sites is not None:
        out = out.where(F.col("site").isin(list(sites)))
    if members is not None:
        out = out.where(F.col("driver_member").isin(list(members)))
    return out


def missing_pairs(found: DataFrame, sites: Sequence[int], members: Sequence[int]) -> DataFrame:
    """Pairs of site and member that no file gives."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(s, m) for s in sites for m in members], "site int, driver_member long")
    return wanted.join(found.select("site", "driver_member").distinct(), ["site", "driver_member"], "left_anti")


def parse_netcdf3(data: bytes) -> tuple[dict[str, object], dict[str, tuple[np.ndarray, dict[str, object]]]]:
    """Attributes and variables of a classic netCDF file (formats 1 and 2), by the published layout."""
    at = 4
    if data[:3] != b"CDF" or data[3] not in (1, 2):
        raise ValueError("not a classic netCDF file")
    offset = ">i8" if data[3] == 2 else ">i4"
    kinds = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}

    def take(kind: str, n: int = 1) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += -(-out.nbytes // 4) * 4
        return out

    def whole() -> int:
        return int(take(">i4")[0])

    def text() -> str:
        n = whole()
        return take("S1", n).tobytes().decode() if n else ""

    def attributes() -> dict[str, object]:
        _, n = whole(), whole()
        out: dict[str, object] = {}
        for _ in range(n):
            name, kind, size = text(), whole(), whole()
            held = take(kinds[kind], size)
            out[name] = held.tobytes().decode().rstrip("\0") if kind == 2 else held.tolist()[0] if size == 1 else held.tolist()
        return out

    records = whole()
    _, n_dims = whole(), whole()
    dims = [(text(), whole()) for _ in range(n_dims)]
    top = attributes()
    _, n_vars = whole(), whole()
    heads = []
    for _ in range(n_vars):
        name = text()
        axes = [whole() for _ in range(whole())]
        held, kind, _size = attributes(), whole(), whole()
        heads.append((name, axes, held, kind, int(np.frombuffer(data, offset, 1, at)[0])))
        at += np.dtype(offset).itemsize
    out = {}
    for name, axes, held, kind, begin in heads:
        if axes and dims[axes[0]][1] == 0:
            raise ValueError(f"{name} has a record dimension of {records} records, which the sources' files don't")
        shape = [dims[a][1] for a in axes]
        out[name] = np.frombuffer(data, kinds[kind], int(np.prod(shape, dtype=int)), begin).reshape(shape), held
    return top, out


#: Path of an initial-condition file: site and member.
INITIAL_PATH = r"IC_site_(\d+)_(\d+)\.nc$"
INITIAL_FILL = -999.0


def initial_conditions(spark: SparkSession, root: str, pattern: str = INITIAL_PATH) -> DataFrame:
    """``site, initial_condition_member, source_index`` and five variables, one row a file, from many small files."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.nc").load(root)
    named = files.where(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).cast("int").alias("site"), F.regexp_extract("path", pattern, 2).cast("long").alias("source_index"), "content")
    names = list(S.INITIAL_VARIABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list[float | None]] = {n: [] for n in names}
            for content in batch.column(2):
                _, held = parse_netcdf3(content.as_py())
                for n in names:
                    value = float(held[n][0].ravel()[0]) if n in held and held[n][0].size == 1 else None
                    if n in held and held[n][0].size != 1:
                        raise ValueError(f"{n} has {held[n][0].size} values")
                    columns[n].append(None if value is None or value == INITIAL_FILL or np.isnan(value) else value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(columns[n], pa.float64()) for n in names)], ["site", "source_index", *names])

    out = named.mapInArrow(run, "site int, source_index long, " + ", ".join(f"{n} double" for n in names))
    return out.select("site", (F.col("source_index") - 1).alias("initial_condition_member"), "source_index", *names)


def phenology(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"year": S.LONG, "site_id": S.LONG, "lat": S.DOUBLE, "lon": S.DOUBLE, "leafonday": S.DOUBLE, "leafoffday": S.DOUBLE, "leafon_qa": S.LONG, "leafoff_qa": S.LONG}
    return read_table(spark, path, T.StructType([T.StructField(n, t) for n, t in kinds.items()]), missing="NA")


def key_map(spark: SparkSession, path: str) -> DataFrame:
    """``site_id, index``, unique both ways."""
    raw = read_table(spark, path, T.StructType([T.StructField("Site_ID", T.LongType()), T.StructField("index", T.LongType())]))
    return raw.select(F.col("Site_ID").alias("site_id"), "index")


def site_listing(spark: SparkSession, path: str) -> DataFrame:
    """Five columns of the towers' tab-separated listing, found by their names."""
    names = {"Site ID": "tower", "Latitude (degrees)": "lat", "Longitude (degrees)": "lon", "Vegetation Abbreviation (IGBP)": "vegetation", "AmeriFlux FLUXNET DOI": "doi"}
    raw = spark.read.options(header=True, sep="\t", mode="FAILFAST").csv(path)
    return raw.select(*(F.col(f"`{a}`").cast("double" if b in ("lat", "lon") else "string").alias(b) for a, b in names.items()))


def pool_inputs(spark: SparkSession, path: str) -> DataFrame:
    """The pool's input list with the position of each row, which decides between entries of a cell."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("_c0", T.LongType()), ("Site.ID", T.StringType()), ("Latitude..degrees.", T.DoubleType()), ("Longitude..degrees.", T.DoubleType()), ("Elevation..m.", T.DoubleType()))])
    raw = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=True).csv(path)
    return raw.select(F.col("_c0").alias("position"), F.col("`Site.ID`").alias("tower"), F.col("`Latitude..degrees.`").alias("lat"), F.col("`Longitude..degrees.`").alias("lon"))


def parse_points(shape: bytes, table: bytes, encoding: str) -> list[dict[str, object]]:
    """Points of a shapefile with the attributes of its table, by the published layouts."""
    import struct

    if struct.unpack_from(">i", shape)[0] != 9994 or struct.unpack_from("<i", shape, 32)[0] != 1:
        raise ValueError("not a shapefile of points")
    points, at = [], 100
    while at < len(shape):
        words = struct.unpack_from(">i", shape, at + 4)[0]
        kind = struct.unpack_from("<i", shape, at + 8)[0]
        points.append(struct.unpack_from("<dd", shape, at + 12) if kind == 1 else (None, None))
        at += 8 + 2 * words
    n, head, size = struct.unpack_from("<IHH", table, 4)
    fields, at = [], 32
    while table[at] != 0x0D:
        fields.append((table[at : at + 11].split(b"\0")[0].decode(encoding), chr(table[at + 11]), table[at + 16]))
        at += 32
    if n != len(points):
        raise ValueError(f"{len(points)} points have {n} rows of attributes")
    rows = []
    for i, (x, y) in enumerate(points):
        at, row = head + i * size + 1, {"x": x, "y": y}
        for name, kind, width in fields:
            text = table[at : at + width].decode(encoding).strip()
            row[name] = (float(text) if kind in "NF" else text) if text else None
            at += width
        rows.append(row)
    return rows


#: Bytes of a shapefile that the driver reads at most.
SHAPE_BYTES = 64 << 20


def shapefile_points(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], encoding: str = "utf-8") -> DataFrame:
    """``x, y`` and attributes of the points of one shapefile (its ``.shp`` and ``.dbf``), in their order.

    The format is read as a whole; a shapefile has two gigabytes at most, and one above ``SHAPE_BYTES`` is refused.
    """
    sizes = spark.read.format("binaryFile").load([f"{path}.shp", f"{path}.dbf"]).agg(F.sum("length")).first()[0]
    if sizes > SHAPE_BYTES:
        raise ValueError(f"{path} has {sizes} bytes, more than {SHAPE_BYTES}")
    held = {r["path"].rsplit(".", 1)[1].lower(): bytes(r["content"]) for r in spark.read.format("binaryFile").load([f"{path}.shp", f"{path}.dbf"]).select("path", "content").collect()}
    rows = [(i, r["x"], r["y"], *(r[c] for c, _ in columns)) for i, r in enumerate(parse_points(held["shp"], held["dbf"], encoding))]
    return spark.createDataFrame(rows, ", ".join(["position int", "x double", "y double", *(f"`{c}` {t}" for c, t in columns)]))


def driver_presence(found: DataFrame, sites: Sequence[int], members: Sequence[int]) -> DataFrame:
    """Every pair of site and member with whether a file gives it."""
    spark = found.sparkSession
    wanted = spark.createDataFrame([(s, m) for s in sites for m in members], "site int, driver_member long")
    held = found.select("site", "driver_member").distinct().withColumn("__held", F.lit(True))
    return wanted.join(held, ["site", "driver_member"], "left").select("site", "driver_member", F.coalesce("__held", F.lit(False)).alias("driver_present"))
