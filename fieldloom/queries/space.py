"""Grids, distances, projections and nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldloom.functions import spatial as S
from fieldloom.operators.spatial import nearest_within, projected_bounds
from fieldloom.queries import query, rounded
from fieldloom.session import table

_POINTS = "select c_custkey as k, c_acctbal / 100 - 100 as lon, c_nationkey * 2.5 + 15 as lat from customer"


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 100 - 100).alias("lon"), (F.col("c_nationkey") * 2.5 + 15).alias("lat"))


@query(f"""with p as ({_POINTS}) select k, floor((lon + 180) * 12)::int as lon_index, floor((lat + 90) * 12)::int as lat_index,
round(-180 + (floor((lon + 180) * 12) + 0.5) / 12, 9) as center_lon, round(-90 + (floor((lat + 90) * 12) + 0.5) / 12, 9) as center_lat from p""")
def grid_cell_bin(spark, sf):
    i, j = S.cell_index(F.col("lon"), F.col("lat"), 12)
    cells = _points(spark, sf).withColumns({"lon_index": i, "lat_index": j})
    lon, lat = S.center(F.col("lon_index"), F.col("lat_index"), 12)
    return rounded(cells.select("k", "lon_index", "lat_index", lon.alias("center_lon"), lat.alias("center_lat")), 9)


@query(f"""with p as ({_POINTS}) select k, floor((lon + 180) * 12)::int as lon_index, floor((lat + 90) * 12)::int as lat_index from p""")
def grid_center_roundtrip(spark, sf):
    """Centers of cells, found again by their coordinates."""
    i, j = S.cell_index(F.col("lon"), F.col("lat"), 12)
    cells = _points(spark, sf).withColumns({"i": i, "j": j})
    lon, lat = S.center(F.col("i"), F.col("j"), 12)
    a, b = S.center_index(lon, lat, 12)
    return cells.select("k", a.alias("lon_index"), b.alias("lat_index"))


@query(f"""with p as ({_POINTS}) select k, round(2 * 6371008.8 * asin(sqrt(least(pow(sin(radians(40 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40)) * pow(sin(radians(-100 - lon) / 2), 2), 1))), 3) as meters from p""")
def haversine(spark, sf):
    return rounded(_points(spark, sf).select("k", S.haversine_m(F.col("lon"), F.col("lat"), F.lit(-100.0), F.lit(40.0)).alias("meters")), 3)


@query(f"""with p as ({_POINTS}) select k, lon, lat from p where degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(45.0)) + cos(radians(lat)) * cos(radians(45.0)) * cos(radians(lon + 100)))))) <= 20""")
def within_angle(spark, sf):
    return _points(spark, sf).where(S.angular_distance(F.col("lon"), F.col("lat"), -100.0, 45.0) <= 20)


def _equal_area_sql(lon0: float, lat0: float, points: str = _POINTS, places: int = 3) -> str:
    e2 = S.FLATTENING * (2 - S.FLATTENING)
    e, s0 = math.sqrt(e2), math.sin(math.radians(lat0))

    def q(s: str) -> str:
        return f"(1 - {e2!r}::double) * ({s} / (1 - {e2!r}::double * {s} * {s}) - ln((1 - {e!r}::double * {s}) / (1 + {e!r}::double * {s})) / (2 * {e!r}::double))"

    return f"""with p as ({points}), a as (select k, sin(radians(lat)) as s, radians(lon - ({lon0})) as lam from p), c as (select {q('1.0::double')} as qp, {q(f'{s0!r}::double')} as q0),
b as (select k, lam, asin(greatest(least(({q('s')}) / qp, 1), -1)) as beta, asin(q0 / qp) as beta0, {S.A_M}::double * sqrt(qp / 2) as rq from a, c),
d as (select *, {S.A_M}::double * {math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0)!r}::double / (rq * cos(beta0)) as d, rq * sqrt(2 / (1 + sin(beta0) * sin(beta) + cos(beta0) * cos(beta) * cos(lam))) as b from b)
select k, round(b * d * cos(beta) * sin(lam), {places}) as x, round((b / d) * (cos(beta0) * sin(beta) - sin(beta0) * cos(beta) * cos(lam)), {places}) as y from d"""


@query(_equal_area_sql(-100.0, 45.0))
def equal_area_projection(spark, sf):
    x, y = S.equal_area(F.col("lon"), F.col("lat"), -100.0, 45.0)
    return rounded(_points(spark, sf).select("k", x.alias("x"), y.alias("y")), 3)


_EDGES = """select i as k, -125 + i / 256.0 * 59 as lon, 24.0 as lat from generate_series(0, 256) t(i) union all select i, -125 + i / 256.0 * 59, 50.0 from generate_series(0, 256) t(i)
union all select i, -125.0, 24 + i / 256.0 * 26 from generate_series(0, 256) t(i) union all select i, -66.0, 24 + i / 256.0 * 26 from generate_series(0, 256) t(i)"""


def _distortion_sql(lon0: float, lat0: float) -> str:
    """Derivatives of the projection in closed form."""
    e2 = S.FLATTENING * (2 - S.FLATTENING)
    e, s0 = math.sqrt(e2), math.sin(math.radians(lat0))

    def q(s: str) -> str:
        return f"((1 - {e2!r}::double) * ({s} / (1 - {e2!r}::double * {s} * {s}) - ln((1 - {e!r}::double * {s}) / (1 + {e!r}::double * {s})) / (2 * {e!r}::double)))"

    return f"""with p as ({_POINTS}), a as (select k, sin(radians(lat)) as s, cos(radians(lat)) as c, radians(lon - ({lon0})) as lam from p),
c0 as (select {q('1.0::double')} as qp, {q(f'{s0!r}::double')} as q0),
b as (select k, s, c, lam, asin({q('s')} / qp) as beta, asin(q0 / qp) as beta0, {S.A_M}::double * sqrt(qp / 2) as rq, 2 * (1 - {e2!r}::double) * c / pow(1 - {e2!r}::double * s * s, 2) / sqrt(qp * qp - pow({q('s')}, 2)) as db from a, c0),
d as (select *, {S.A_M}::double * {math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0)!r}::double / (rq * cos(beta0)) as d, 1 + sin(beta0) * sin(beta) + cos(beta0) * cos(beta) * cos(lam) as t from b),
g as (select *, rq * sqrt(2 / t) as b, -rq * sqrt(2 / t) / (2 * t) * (sin(beta0) * cos(beta) - cos(beta0) * sin(beta) * cos(lam)) as bb, rq * sqrt(2 / t) / (2 * t) * cos(beta0) * cos(beta) * sin(lam) as bl, cos(beta0) * sin(beta) - sin(beta0) * cos(beta) * cos(lam) as y0 from d),
j as (select k, s, c, d * (bl * cos(beta) * sin(lam) + b * cos(beta) * cos(lam)) as xl, (bl * y0 + b * sin(beta0) * cos(beta) * sin(lam)) / d as yl,
d * (bb * cos(beta) * sin(lam) - b * sin(beta) * sin(lam)) * db as xp, (bb * y0 + b * (cos(beta0) * cos(beta) + sin(beta0) * sin(beta) * cos(lam))) / d * db as yp from g),
m as (select *, {S.A_M}::double * (1 - {e2!r}::double) / pow(1 - {e2!r}::double * s * s, 1.5) as m, {S.A_M}::double * c / sqrt(1 - {e2!r}::double * s * s) as n from j),
f as (select k, xp, yp, (xp * xp + yp * yp) / (m * m) + (xl * xl + yl * yl) / (n * n) as hk, (yp * xl - xp * yl) / (m * n) as area from m),
w as (select k, xp, yp, area, sqrt(greatest(hk + 2 * area, 0)) as both_, sqrt(greatest(hk - 2 * area, 0)) as apart from f)
select k, round((both_ + apart) / 2, 3) as semimajor, round((both_ - apart) / 2, 3) as semiminor, round(area, 6) as areal_scale, round(degrees(2 * asin(least(apart / both_, 1))), 1) as angular, round(-degrees(atan2(xp, yp)), 4) as convergence from w"""


@query(_distortion_sql(-100.0, 45.0))
def projection_distortion(spark, sf):
    """Scales, angles and convergence from differences; its SQL has the derivatives in closed form."""
    found = S.distortion(F.col("lon"), F.col("lat"), -100.0, 45.0)
    places = {"semimajor": 3, "semiminor": 3, "areal_scale": 6, "angular": 1, "convergence": 4}
    return _points(spark, sf).select("k", *(F.round(c, places[n]).alias(n) for n, c in found.items()))


@query(f"select min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max from ({_equal_area_sql(-100.0, 45.0, _EDGES)})")
def projected_box(spark, sf):
    """Bounds of a box in the equal-area plane; its edges curve, so they are sampled."""
    return rounded(projected_bounds(spark, (-125.0, 24.0, -66.0, 50.0), -100.0, 45.0), 3)


_NEAREST = """with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, label from embeddings),
n as (select a.vec_id, b.vec_id as site, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as d from p a join p b on a.label <> 0 and b.label = 0 and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05)
select p.vec_id, site, round(d, 6) as distance from p left join (select vec_id, min(d) as d, arg_min(site, struct_pack(d := d, s := site)) as site from n group by 1) using (vec_id) where label <> 0"""


@query(_NEAREST)
def nearest_within_radius(spark, sf):
    at = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    points, sites = at.where("label <> 0").drop("label"), at.where("label = 0").select(F.col("vec_id").alias("site"), "x", "y")
    return rounded(nearest_within(points, sites, "vec_id", "site", 0.05).select("vec_id", "site", "distance"))


_SOLAR = """1361.0 * (1.00011 + 0.034221 * cos(g) + 0.00128 * sin(g) + 0.000719 * cos(2 * g) + 0.000077 * sin(2 * g)) * greatest(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians((h * 60 + eq + 4 * lon) / 4 - 180)), 0)"""
_SPENCER = """0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) as dec,
229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) as eq"""


@query(f"""with e as (select user_id % 20 as k, epoch_us(ts) as us, -100.0 + user_id % 20 as lon, 30.0 + user_id % 20 as lat, case when hour(ts) between 6 and 18 then value else 0 end as m from events),
o as (select k, us + off * 1800000000 as us, off / 2.0 as off, lon, lat, m from e, generate_series(-24, 24) t(off)),
t as (select *, 2 * pi() * (dayofyear(make_timestamp(us)) - 1 + ((us % 86400000000) / 3.6e9 - 12) / 24) / 365 as g, (us % 86400000000) / 3.6e9 as h from o),
d as (select *, {_SPENCER} from t), s as (select k, off, sqrt(avg(pow(m - {_SOLAR}, 2))) as rmse from d group by 1, 2),
n as (select *, row_number() over (partition by k order by rmse, off) as n from s)
select a.k, a.off as best_offset, round(a.rmse, 4) as best_rmse, b.off as next_offset, round(b.rmse / a.rmse, 4) as separation from n a join n b on a.k = b.k and a.n = 1 and b.n = 2""")
def offset_grid_search(spark, sf):
    from fieldloom.functions.time import micros
    from fieldloom.operators.clocks import offset_search

    steps = table(spark, sf, "events").select(
        F.pmod("user_id", F.lit(20)).alias("k"), micros(F.col("ts")).alias("us"), (F.pmod("user_id", F.lit(20)) - 100.0).alias("lon"), (F.pmod("user_id", F.lit(20)) + 30.0).alias("lat"),
        F.when(F.hour("ts").between(6, 18), F.col("value")).otherwise(0.0).alias("measured"),
    )
    return rounded(offset_search(steps, ["k"], "us", "measured", "lon", "lat").select("k", "best_offset", "best_rmse", "next_offset", "separation"), 4)
