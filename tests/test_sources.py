import datetime as dt
import gzip
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.operators.checks import ContractViolation, gaps_in_stamps
from fieldloom.functions.time import HOUR, micros
from fieldloom.sources import scans, schemas, sinks

D = dt.datetime


def test_site_table_keeps_names_and_refuses_big_integers(spark, tmp_path):
    head = ",".join(f.name for f in schemas.SITES)
    good = tmp_path / "sites.csv"
    good.write_text(f"{head}\n1,-93.287501017252595,40.5,10,20,NA,1,2,3,US-Aaa\n2,-90,41,11,21,,0,2,3,\n")
    rows = scans.sites(spark, str(good)).orderBy("site_id").collect()
    assert [(r["site_name"], r["ameriflux_site_id"], r["lon"]) for r in rows] == [("NA", "US-Aaa", -93.2875010172526), ("", "", -90.0)]
    bad = tmp_path / "bad.csv"
    bad.write_text(f"{head}\n1,0,0,10,20,x,1,300,3,y\n")
    with pytest.raises(PySparkException):
        scans.sites(spark, str(bad)).collect()
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="header"):
        scans.sites(spark, str(wrong)).collect()


def test_constraints_by_their_structure(spark, tmp_path):
    def put(name, text):
        path = tmp_path / f"{name}.csv.gz"
        path.write_bytes(gzip.compress(text.encode()))
        return scans.constraint(spark, str(path), schemas.CONSTRAINTS[name])

    lai = put("modis_leaf_area_index", "date,site_id,lat,lon,lai,sd,qc\n2012-05-01,1,0,0,2.5,0.1,000\n2012-05-02,1,0,0,2.6,0.1,001\n2012-05-03,2,0,0,NA,NA,000\n")
    assert [(r["site"], r["time"], r["value"]) for r in lai.collect()] == [(1, D(2012, 5, 1), 2.5)]
    agb = put("landtrendr_aboveground_biomass", "site_id,year,agb_mean,agb_sd\n1,2012,10,1\n").first()
    assert (agb["window_start"], agb["window_end"]) == (D(2012, 1, 1), D(2013, 1, 1))
    soc = put("soilgrids_soil_organic_carbon", "site_id,soc,sd,year\n1,5,1,2012\n1,5,1,2013\n2,NA,NA,2012\n")
    assert [(r["site"], r["time"], r["value"]) for r in soc.collect()] == [(1, None, 5.0)]
    with pytest.raises(PySparkException, match="copies of a static value differ"):
        put("soilgrids_soil_organic_carbon", "site_id,soc,sd,year\n1,5,1,2012\n1,6,1,2013\n").collect()
    with pytest.raises(PySparkException, match="missing together"):
        put("smap_soil_moisture", "date,site_id,lat,lon,smp,sd\n2012-05-01,1,0,0,2.5,NA\n").collect()


def test_tower_files(spark, tmp_path):
    folder = tmp_path / "US-Aaa"
    folder.mkdir()
    (folder / "AMF_US-Aaa_FLUXNET_FULLSET_HR_2012-2012_3-5.csv").write_text("TIMESTAMP_START,TIMESTAMP_END,NEE_VUT_REF,NEE_VUT_REF_QC,NIGHT\n201201010000,201201010100,-9999,0,1\n201201010100,201201010200,2.5,1,1\n201201010300,201201010400,3,1,0\n")
    (tmp_path / "AMF_US-Bbb_FLUXNET_FULLSET_HH_2012-2013_1-1.csv").write_text("TIMESTAMP_START,TIMESTAMP_END,NIGHT,NEE_VUT_REF\n201201010000,201201010030,0,7\n")
    steps = scans.fullset(spark, str(tmp_path), ["VUT_REF"], ["NIGHT"])
    rows = [(r["tower"], r["resolution"], r["time"], r["NEE_VUT_REF"], r["NEE_VUT_REF_QC"], r["NEE_VUT_REF_RANDUNC"]) for r in steps.orderBy("tower", "time").collect()]
    assert rows == [("US-Aaa", "HR", D(2012, 1, 1, 1), None, 0.0, None), ("US-Aaa", "HR", D(2012, 1, 1, 2), 2.5, 1.0, None), ("US-Aaa", "HR", D(2012, 1, 1, 4), 3.0, 1.0, None), ("US-Bbb", "HH", D(2012, 1, 1, 0, 30), 7.0, None, None)]
    assert gaps_in_stamps(steps.where("tower = 'US-Aaa'"), ["tower"], micros(F.col("time")), HOUR).count() == 1


def test_driver_files(spark, tmp_path):
    folder = tmp_path / "ERA5_7_2"
    folder.mkdir()
    line = "0 2012 {day} {hour} 0.125 " + " ".join(str(float(i)) for i in range(8)) + " 0.5"
    (folder / "ERA5.2.2012-01-01.2012-12-31.clim").write_text("\n".join(line.format(day=d, hour=h) for d in (1, 60) for h in (0, 3, 21)) + "\n")
    rows = scans.drivers(spark, str(tmp_path), sites=[7]).orderBy("time").collect()
    assert [(r["driver_member"], r["timestep_start"], r["time"]) for r in rows[2:4]] == [(1, D(2012, 1, 1, 21), D(2012, 1, 2)), (1, D(2012, 2, 29), D(2012, 2, 29, 3))]
    assert scans.missing_pairs(scans.drivers(spark, str(tmp_path)), [7, 8], [1]).collect()[0]["site"] == 8


def netcdf3(values, fill=-999.0):
    def text(x):
        data = x.encode()
        return struct.pack(">i", len(data)) + data + b"\0" * (-len(data) % 4)

    def attributes(held):
        body = b"".join(text(k) + struct.pack(">ii", 6, 1) + struct.pack(">d", v) for k, v in held.items())
        return struct.pack(">ii", 12 if held else 0, len(held)) + body

    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 1) + text("time") + struct.pack(">i", 1) + attributes({})
    sizes = [len(text(n)) + 4 + 4 + len(attributes({"_FillValue": fill})) + 12 for n in values]
    begin, body, data = len(head) + 8 + sum(sizes), b"", b""
    for i, (n, v) in enumerate(values.items()):
        body += text(n) + struct.pack(">ii", 1, 0) + attributes({"_FillValue": fill}) + struct.pack(">iii", 6, 8, begin + 8 * i)
        data += struct.pack(">d", v)
    return head + struct.pack(">ii", 11, len(values)) + body + data


def test_initial_condition_files(spark, tmp_path):
    for site, member, carbon in ((1, 1, 2.5), (1, 2, -999.0)):
        (tmp_path / f"IC_site_{site}_{member}.nc").write_bytes(netcdf3({"AbvGrndWood": carbon, "SoilMoistFrac": 30.0}))
    rows = scans.initial_conditions(spark, str(tmp_path)).orderBy("source_index").collect()
    assert [(r["site"], r["initial_condition_member"], r["AbvGrndWood"], r["SoilMoistFrac"], r["leaf_carbon_content"]) for r in rows] == [(1, 0, 2.5, 30.0, None), (1, 1, None, 30.0, None)]
    _, held = scans.parse_netcdf3((tmp_path / "IC_site_1_1.nc").read_bytes())
    assert held["AbvGrndWood"][1] == {"_FillValue": -999.0}
    with pytest.raises(ValueError):
        scans.parse_netcdf3(b"HDF....")


def test_small_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert scans.site_listing(spark, put("l.tsv", "Site ID\tx\tLatitude (degrees)\tLongitude (degrees)\tVegetation Abbreviation (IGBP)\tAmeriFlux FLUXNET DOI\nUS-A\t1\t40\t-90\tENF\td\n")).first()["lat"] == 40.0
    assert scans.pool_inputs(spark, put("p.csv", '"",Site.ID,Latitude..degrees.,Longitude..degrees.,Elevation..m.\n1,US-A,40,-90,100\n')).first()["tower"] == "US-A"
    assert scans.key_map(spark, put("k.csv", "Site_ID,index\n5,1\n")).first()["site_id"] == 5
    labels = put("s.csv", "site,pft\n1,grass\n2,\n")
    assert scans.site_labels(spark, labels, "site", "pft", ["grass"]).count() == 1
    with pytest.raises(PySparkException, match="no class is grass"):
        scans.site_labels(spark, labels, "site", "pft", ["trees"]).collect()


def test_checked_write(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 1.5), (2, "b", None)], "k int, s string, v double")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.checked_write({a: frame, b: frame.where("k = 1")}, {a: ["k"]})
    assert spark.read.parquet(a).count() == 2 and spark.read.parquet(b).count() == 1
    sinks.checked_write({a: frame.where("k = 2")})
    assert spark.read.parquet(a).count() == 1
    noisy = frame.withColumn("v", F.udf(lambda: random.random(), "double").asNondeterministic()())  # another table each time
    with pytest.raises(ContractViolation):
        sinks.checked_write({a: noisy})
    assert spark.read.parquet(a).count() == 1
    assert sinks.digests(spark, a, "*.parquet").count() >= 1
    sinks.provenance(spark, str(tmp_path / "p"), sinks.digests(spark, b, "*.parquet"), {"seed": 1})
    assert '"seed": 1' in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "p")).collect())


def test_shapefile_points(spark, tmp_path):
    points = [(-90.5, 40.25), (10.0, -3.0)]
    records = b"".join(struct.pack(">ii", i + 1, 10) + struct.pack("<idd", 1, *p) for i, p in enumerate(points))
    (tmp_path / "s.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 20 + struct.pack(">i", (100 + len(records)) // 2) + struct.pack("<ii", 1000, 1) + b"\0" * 64 + records)
    field = lambda n, k, w: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14
    head = field("name", "C", 6) + field("rank", "N", 4) + b"\x0d"
    body = b"".join(b" " + n.encode().ljust(6) + r.rjust(4).encode() for n, r in (("first", "7"), ("", "")))
    (tmp_path / "s.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", 2, 32 + len(head), 11) + b"\0" * 20 + head + body)
    rows = scans.shapefile_points(spark, str(tmp_path / "s"), [("name", "string"), ("rank", "double")]).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [(0, -90.5, 40.25, "first", 7.0), (1, 10.0, -3.0, None, None)]
