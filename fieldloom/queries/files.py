"""Scans of every declared file format, from files that the query writes out of the carrier tables, and the sinks."""

from __future__ import annotations

import datetime as dt
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators import reshape as R
from fieldloom.operators import surveys as V
from fieldloom.queries import query, rounded
from fieldloom.session import table
from fieldloom.sources import scans, schemas, sinks
from fieldloom.staging import Workspace


_HOUR = dt.timedelta(hours=1)


def _folder(spark) -> str:
    return Workspace(spark, "files").path


def _csv(frame, path: str, **options) -> str:
    """A folder of delimited files with a header each."""
    frame.write.options(header=True, emptyValue="", **options).csv(path)
    return path


@query("""select n_nationkey::int as site_id, n_nationkey * 7.25 - 90 as lon, n_regionkey * 10.5 + 0.1 as lat, n_nationkey::int as lon_index, n_regionkey::int as lat_index,
case when n_nationkey % 5 = 0 then 'NA' when n_nationkey % 5 = 1 then '' else n_name end as site_name, n_nationkey::int as site_order, n_regionkey::tinyint as cluster, 3::tinyint as landcover, n_name as ameriflux_site_id from nation""")
def scan_site_table(spark, sf):
    """The site table: NA is a name, an empty name stays empty."""
    key = F.col("n_nationkey")
    name = F.when(key % 5 == 0, "NA").when(key % 5 == 1, "").otherwise(F.col("n_name"))
    rows = table(spark, sf, "nation").select(
        key.alias("site_id"), (key * 7.25 - 90).alias("lon"), (F.col("n_regionkey") * 10.5 + 0.1).alias("lat"), key.alias("lon_index"), F.col("n_regionkey").alias("lat_index"), name.alias("site_name"),
        key.alias("site_order"), F.col("n_regionkey").alias("cluster"), F.lit(3).alias("landcover"), F.col("n_name").alias("ameriflux_site_id"),
    )
    return scans.sites(spark, _csv(rows, f"{_folder(spark)}/sites"))


@query("""select c_custkey::int as site_id, c_mktsegment as label from customer where c_acctbal > 0""")
def scan_site_labels(spark, sf):
    customer = table(spark, sf, "customer")
    path = _csv(customer.select(F.col("c_custkey").alias("site"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("pft")), f"{_folder(spark)}/labels")
    return scans.site_labels(spark, path, "site", "pft", ["BUILDING", "MACHINERY", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE"])


@query("""select 'modis_leaf_area_index' as source, o_custkey::int as site, o_orderdate::timestamp as "time", null::timestamp as window_start, null::timestamp as window_end, o_totalprice as value, o_totalprice / 8 as standard_deviation
from orders where o_orderkey % 7 <> 0 and o_orderpriority <> '5-LOW'""")
def scan_constraint_dated(spark, sf):
    """A dated source from gzipped files: the quality flag filters, what is missing is dropped."""
    there = F.col("o_orderkey") % 7 != 0
    rows = table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_custkey").alias("site_id"), F.lit(0.5).alias("lat"), F.lit(1.5).alias("lon"), F.when(there, F.col("o_totalprice").cast("string")).otherwise("NA").alias("lai"),
        F.when(there, (F.col("o_totalprice") / 8).cast("string")).otherwise("NA").alias("sd"), F.when(F.col("o_orderpriority") == "5-LOW", "001").otherwise("000").alias("qc"),
    )
    return scans.constraint(spark, _csv(rows, f"{_folder(spark)}/dated", compression="gzip"), schemas.CONSTRAINTS["modis_leaf_area_index"])


@query("""select 'landtrendr_aboveground_biomass' as source, l_suppkey::int as site, make_timestamp(year(l_shipdate), 1, 1, 0, 0, 0) as "time", make_timestamp(year(l_shipdate), 1, 1, 0, 0, 0) as window_start,
make_timestamp(year(l_shipdate) + 1, 1, 1, 0, 0, 0) as window_end, sum(l_quantity) as value, count(*)::double as standard_deviation from lineitem group by l_suppkey, year(l_shipdate)""")
def scan_constraint_annual(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("site_id"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("agb_mean"), F.count("*").cast("double").alias("agb_sd"))
    return scans.constraint(spark, _csv(rows, f"{_folder(spark)}/annual", compression="gzip"), schemas.CONSTRAINTS["landtrendr_aboveground_biomass"])


@query("""select 'soilgrids_soil_organic_carbon' as source, c_custkey::int as site, null::timestamp as "time", null::timestamp as window_start, null::timestamp as window_end, c_acctbal as value, 1.5::double as standard_deviation from customer where c_custkey % 4 <> 0""")
def scan_constraint_static(spark, sf):
    """A static source, of which the files hold equal copies for several years."""
    there = F.col("c_custkey") % 4 != 0
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("site_id"), F.when(there, F.col("c_acctbal").cast("string")).otherwise("NA").alias("soc"), F.when(there, "1.5").otherwise("NA").alias("sd"), F.explode(F.array(F.lit(2012), F.lit(2013), F.lit(2014))).alias("year")
    )
    return scans.constraint(spark, _csv(rows, f"{_folder(spark)}/static", compression="gzip"), schemas.CONSTRAINTS["soilgrids_soil_organic_carbon"])


@query("""select event_type as tower, 'HR' as resolution, '1-1' as version, date_trunc('hour', ts) as timestep_start, date_trunc('hour', ts) + interval 1 hour as "time",
case when count(*) % 5 > 0 then round(sum(value), 6) end as NEE_VUT_REF, (count(*) % 4)::double as NEE_VUT_REF_QC, null::double as NEE_VUT_REF_RANDUNC, null::double as NEE_VUT_REF_JOINTUNC, (hour(date_trunc('hour', ts)) < 6)::int::double as NIGHT
from events group by event_type, date_trunc('hour', ts)""")
def scan_tower_files(spark, sf):
    """Hourly files of towers; their headers differ in the order of columns, and the fill value is missing."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    hourly = table(spark, sf, "events").groupBy("event_type", hour.alias("at")).agg(F.sum("value").alias("v"), F.count("*").alias("n")).orderBy("event_type", "at")
    root, files = _folder(spark), {}
    for r in hourly.toLocalIterator():  # some hundred rows a tower
        files.setdefault(r["event_type"], []).append(r)
    for i, (tower, rows) in enumerate(sorted(files.items())):
        names = ["TIMESTAMP_START", "TIMESTAMP_END", "NEE_VUT_REF", "NEE_VUT_REF_QC", "NIGHT"]
        if i % 2:
            names[2:] = reversed(names[2:])
        lines = [",".join(names)]
        for r in rows:
            end = r["at"] + _HOUR
            cells = {"TIMESTAMP_START": f"{r['at']:%Y%m%d%H%M}", "TIMESTAMP_END": f"{end:%Y%m%d%H%M}", "NEE_VUT_REF": repr(r["v"]) if r["n"] % 5 else "-9999", "NEE_VUT_REF_QC": str(r["n"] % 4), "NIGHT": str(int(r["at"].hour < 6))}
            lines.append(",".join(cells[n] for n in names))
        sinks.put(spark, f"{root}/{tower}/AMF_{tower}_FLUXNET_FULLSET_HR_2024-2024_1-1.csv", "\n".join([*lines, ""]).encode())
    return rounded(scans.fullset(spark, root, ["VUT_REF"], ["NIGHT"]))


_MEMBERS, _STEPS = 2, 8


def _driver_files(spark, sf) -> str:
    """A text file for each nation and member, of a leap day in steps of three hours."""
    root = _folder(spark)
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        for member in range(1, _MEMBERS + 1):
            if (r["n_nationkey"] + member) % 9 == 0:
                continue  # a file that lacks
            lines = [f"0 2012 60 {3 * k} 0.125 " + " ".join(str(r["n_nationkey"] + 0.5 * i + k) for i in range(8)) + f" {member}" for k in range(_STEPS)]
            sinks.put(spark, f"{root}/ERA5_{r['n_nationkey']}_{member}/ERA5.{member}.2012-02-29.2012-02-29.clim", ("\n".join(lines) + "\n").encode())
    return root


@query(f"""select n_nationkey::int as site, m - 1 as driver_member, timestamp '2012-02-29' + to_hours((3 * k)::int) as timestep_start, timestamp '2012-02-29' + to_hours((3 * k + 3)::int) as "time",
{", ".join(f"n_nationkey + {0.5 * i} + k::double as {v}" for i, v in enumerate(schemas.DRIVER_VARIABLES))}
from nation, generate_series(1, {_MEMBERS}) a(m), generate_series(0, {_STEPS - 1}) b(k) where (n_nationkey + m) % 9 <> 0""")
def scan_driver_files(spark, sf):
    return scans.drivers(spark, _driver_files(spark, sf))


@query(f"""select n_nationkey::int as site, m - 1 as driver_member, (n_nationkey + m) % 9 <> 0 as driver_present from nation, generate_series(1, {_MEMBERS}) a(m)""")
def driver_presence(spark, sf):
    """Every pair of site and member, with whether a file gives it."""
    found = scans.drivers(spark, _driver_files(spark, sf))
    sites = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()]
    return scans.driver_presence(found, sites, list(range(_MEMBERS)))


@query("""select n_nationkey::int as site, m - 1 as initial_condition_member, m as source_index, case when n_nationkey % 3 > 0 then n_nationkey * 1.5 end as AbvGrndWood, n_regionkey + 0.25 as wood_carbon_content,
null::double as leaf_carbon_content, null::double as soil_organic_carbon_content, 10.0 * m + n_regionkey as SoilMoistFrac from nation, generate_series(1, 2) t(m)""")
def scan_initial_conditions(spark, sf):
    """Classic netCDF files of scalars, one a site and member; the fill value and variables that lack are missing."""
    root = _folder(spark)
    for r in table(spark, sf, "nation").collect():
        for member in (1, 2):
            wood = r["n_nationkey"] * 1.5 if r["n_nationkey"] % 3 else scans.INITIAL_FILL
            held = {"AbvGrndWood": wood, "wood_carbon_content": r["n_regionkey"] + 0.25, "SoilMoistFrac": 10.0 * member + r["n_regionkey"]}
            sinks.put(spark, f"{root}/{r['n_nationkey']}/IC_site_{r['n_nationkey']}_{member}.nc", sinks.netcdf3(held, scans.INITIAL_FILL))
    return scans.initial_conditions(spark, root)


@query("""select year(o_orderdate) as year, o_custkey as site_id, 40.5 as lat, -90.25 as lon, dayofyear(o_orderdate)::double as leafonday, case when o_orderkey % 6 > 0 then o_orderkey % 365 + 0.5 end as leafoffday, 1::bigint as leafon_qa, o_orderkey % 3 as leafoff_qa from orders""")
def scan_phenology(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("site_id"), F.lit(40.5).alias("lat"), F.lit(-90.25).alias("lon"), F.dayofyear("o_orderdate").cast("double").alias("leafonday"),
        F.when(F.col("o_orderkey") % 6 > 0, (F.col("o_orderkey") % 365 + 0.5).cast("string")).otherwise("NA").alias("leafoffday"), F.lit(1).alias("leafon_qa"), (F.col("o_orderkey") % 3).alias("leafoff_qa"),
    )
    return scans.phenology(spark, _csv(rows, f"{_folder(spark)}/phenology"))


@query("""select s_suppkey as site_id, s_suppkey * 2 as "index" from supplier""")
def scan_key_map(spark, sf):
    return scans.key_map(spark, _csv(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Site_ID"), (F.col("s_suppkey") * 2).alias("index")), f"{_folder(spark)}/keys"))


@query("""select s_name as tower, s_acctbal / 200 as lat, s_suppkey - 90.5 as lon, 'ENF' as vegetation, case when s_suppkey % 2 = 0 then 'doi' end as doi from supplier""")
def scan_site_listing(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.col("s_name").alias("Site ID"), F.lit("x").alias("Site Name"), (F.col("s_acctbal") / 200).alias("Latitude (degrees)"), (F.col("s_suppkey") - 90.5).alias("Longitude (degrees)"), F.lit("ENF").alias("Vegetation Abbreviation (IGBP)"),
        F.when(F.col("s_suppkey") % 2 == 0, "doi").alias("AmeriFlux FLUXNET DOI"),
    )
    return scans.site_listing(spark, _csv(rows, f"{_folder(spark)}/listing", sep="\t"))


@query("""select s_suppkey as position, s_name as tower, s_acctbal / 200 as lat, s_suppkey - 90.5 as lon from supplier""")
def scan_pool_inputs(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("_c0"), F.col("s_name").alias("Site.ID"), (F.col("s_acctbal") / 200).alias("Latitude..degrees."), (F.col("s_suppkey") - 90.5).alias("Longitude..degrees."), F.lit(100.0).alias("Elevation..m."))
    return scans.pool_inputs(spark, _csv(rows, f"{_folder(spark)}/pool"))


@query("""select n_nationkey::int as position, n_nationkey - 100.5 as x, n_regionkey + 20.25 as y, n_name as name, case when n_nationkey % 4 > 0 then n_regionkey::double end as rank from nation""")
def scan_shapefile(spark, sf):
    """A shapefile of points with two attributes, one of which is missing in places."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    records = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, r["n_nationkey"] - 100.5, r["n_regionkey"] + 20.25) for i, r in enumerate(rows))
    shape = struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", (100 + len(records)) // 2) + struct.pack("<ii", 1000, 1) + bytes(64) + records
    fields = b"".join(n.encode().ljust(11, b"\0") + k + bytes(4) + bytes([w, 0]) + bytes(14) for n, k, w in (("name", b"C", 25), ("rank", b"N", 6))) + b"\x0d"
    body = b"".join(b" " + r["n_name"].encode().ljust(25) + (str(r["n_regionkey"]) if r["n_nationkey"] % 4 else "").rjust(6).encode() for r in rows)
    path = f"{_folder(spark)}/points"
    sinks.put(spark, f"{path}.shp", shape)
    sinks.put(spark, f"{path}.dbf", b"\x03" + bytes(3) + struct.pack("<IHH", len(rows), 32 + len(fields), 32) + bytes(20) + fields + body)
    return scans.shapefile_points(spark, path, [("name", "string"), ("rank", "double")])


@query("""select c_custkey, c_name, c_acctbal, c_mktsegment from customer""")
def checked_write_roundtrip(spark, sf):
    """Two tables published at once after they were read back, one of them in folders by a column."""
    root = _folder(spark)
    frame = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    low, high = frame.where("c_acctbal < 0"), frame.where("not c_acctbal < 0 or c_acctbal is null")
    sinks.checked_write({f"{root}/low": low, f"{root}/high": high}, {f"{root}/high": ["c_mktsegment"]})
    return spark.read.parquet(f"{root}/low").unionByName(spark.read.parquet(f"{root}/high")).select(*frame.columns)


@query("""select concat(r_regionkey, '.txt') as name, length(r_name) as length, md5(r_name) as md5 from region""")
def file_digests(spark, sf):
    root = _folder(spark)
    for r in table(spark, sf, "region").collect():
        sinks.put(spark, f"{root}/{r['r_regionkey']}.txt", r["r_name"].encode())
    return sinks.digests(spark, root, "*.txt").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "md5")


@query("""select n_regionkey::varchar as region, count(*) as files, sum(length(n_name))::bigint as bytes from nation group by 1""")
def file_tree_survey(spark, sf):
    """Files and bytes of each folder, by a template of their paths."""
    root = _folder(spark)
    for r in table(spark, sf, "nation").collect():
        sinks.put(spark, f"{root}/r{r['n_regionkey']}/n{r['n_nationkey']}.txt", r["n_name"].encode())
    listing = sinks.digests(spark, root, "*.txt")
    return V.files_survey(listing, r"/r(\d+)/n\d+\.txt$", ["region"])[0]


@query("""select o_orderkey, case when o_orderkey % 3 > 0 then o_orderkey % 5 else -1 end as flag from orders""")
def flags_as_files_hold_them(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5).alias("flag"))
    return sinks.with_flags(rows, ["flag"])


@query("""select p_partkey, p_name, p_brand, p_size, p_retailprice from part""")
def vertical_split_roundtrip(spark, sf):
    """A table as two with its key each, joined again."""
    part = table(spark, sf, "part")
    names, numbers = R.vertical_split(part, ["p_partkey"], [["p_name", "p_brand"], ["p_size", "p_retailprice"]])
    return names.join(numbers, "p_partkey")


@query("""select p_brand, p_type, p_size, p_partkey from part""")
def typed_scan_of_a_table(spark, sf):
    """Declared types from a file with a header, and nothing inferred."""
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_partkey")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in part.schema])
    return scans.read_table(spark, _csv(part, f"{_folder(spark)}/typed"), schema)
