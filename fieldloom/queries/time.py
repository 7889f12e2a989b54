"""Event-time cells, windows and as-of labels over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.aggregates import sampled_error
from fieldloom.functions.time import DAY, HOUR, micros
from fieldloom.operators import windows as W
from fieldloom.queries import query, rounded
from fieldloom.session import table

_CELL = "make_timestamp(((epoch_us(ts) + 86399999999) // 86400000000) * 86400000000)"
_VALID = "case when event_type <> 'error' then value end"


def _steps(spark: SparkSession, sf: str, gaps: bool = False) -> DataFrame:
    events = table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("value")) if gaps else F.col("value")
    return events.select("event_id", "user_id", "event_type", F.col("ts").alias("time"), value.alias("value"))


@query(f"""select user_id, {_CELL} as cell, round(sum(value), 6) as "sum", count(*) as n_steps, count(value) as n_present
from events group by 1, 2""")
def cell_sum_daily(spark, sf):
    return rounded(W.aggregate_cells(_steps(spark, sf), ["user_id"], "1D", kind="total"))


@query("""select event_type, case when date_trunc('month', ts) = ts then ts else date_trunc('month', ts) + interval 1 month end as cell,
round(arg_max(value, ts), 6) as "last", count(*) as n_steps, count(value) as n_present from events group by 1, 2""")
def cell_last_monthly(spark, sf):
    return rounded(W.aggregate_cells(_steps(spark, sf), ["event_type"], "MS", kind="end_state"))


@query("""select o_orderpriority, case when date_trunc('year', o_orderdate) = o_orderdate then o_orderdate else date_trunc('year', o_orderdate) + interval 1 year end as cell,
round(avg(o_totalprice), 6) as "mean", count(*) as n_steps, count(o_totalprice) as n_present from orders group by 1, 2""")
def cell_mean_yearly(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", F.col("o_orderdate").alias("time"), F.col("o_totalprice").alias("value"))
    return rounded(W.aggregate_cells(orders, ["o_orderpriority"], "YS", kind="mean"))


@query(f"""select user_id, {_CELL} as cell, case when count({_VALID}) = count(*) then round(avg({_VALID}), 6) end as "mean",
count(*) as n_steps, count({_VALID}) as n_present from events group by 1, 2""")
def cell_gap_aware(spark, sf):
    return rounded(W.aggregate_cells(_steps(spark, sf, True), ["user_id"], "1D", kind="mean"))


@query(f"""select user_id, {_CELL} as cell, case when count({_VALID}) = count(*) then round(max({_VALID}), 6) end as "max",
count(*) as n_steps, count({_VALID}) as n_present from events group by 1, 2 having count({_VALID}) >= 3""")
def cell_counts_masked(spark, sf):
    return rounded(W.cells_with(W.aggregate_cells(_steps(spark, sf, True), ["user_id"], "1D", how="max"), 3))


_DAYS = """select d::date as day, d + interval 6 hour as window_start, d + interval 18 hour as window_end
from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day) t(d)"""
_SIX = ", ".join(f"case when count(v) = count(ts) then round({f}, 6) end as \"{n}\"" for n, f in {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "first": "arg_min(v, ts)", "last": "arg_max(v, ts)"}.items())


@query(f"""with w as ({_DAYS}), e as (select ts, {_VALID} as v from events)
select day, window_start, window_end, {_SIX}, count(ts) as n_steps, count(v) as n_present
from w left join e on ts > window_start and ts <= window_end group by 1, 2, 3""")
def window_reduce_all(spark, sf):
    steps = _steps(spark, sf, True).select("time", "value")
    windows = W.daily_windows(spark, "2024-01-01", "2024-01-31", 6, 18)
    return rounded(W.reduce_windows(steps, windows, ["sum", "mean", "min", "max", "first", "last"], ["day", "window_start", "window_end"], width=DAY))


@query(f"""with w as ({_DAYS}), e as (select ts, value, coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 1e6, 0) as len from events)
select day, window_start, window_end, round(sum(value * len) / nullif(sum(len), 0), 6) as "mean", count(ts) as n_steps, count(value) as n_present
from w left join e on ts > window_start and ts <= window_end group by 1, 2, 3""")
def window_weighted_mean(spark, sf):
    steps = _with_starts(_steps(spark, sf)).withColumn("length", F.coalesce((micros(F.col("time")) - micros(F.col("timestep_start"))) / 1e6, F.lit(0.0)))
    windows = W.daily_windows(spark, "2024-01-01", "2024-01-31", 6, 18)
    return rounded(W.reduce_windows(steps.select("time", "value", "length"), windows, ["mean"], ["day", "window_start", "window_end"], weight="length"))


def _with_starts(steps: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return steps.withColumn("timestep_start", F.lag("time").over(Window.partitionBy("user_id").orderBy("time")))


@query(f"""with w as (select user_id, d::date as day, d + interval 0 hour as window_start, d + interval 2 hour as window_end
from (select distinct user_id from events), generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) t(d)), e as (select user_id, ts, {_VALID} as v from events)
select w.user_id, day, count(ts) as n_steps, count(v) as n_present from w left join e on e.user_id = w.user_id and ts > window_start and ts <= window_end group by 1, 2""")
def window_counts_zero_filled(spark, sf):
    steps = _steps(spark, sf, True)
    windows = steps.select("user_id").distinct().crossJoin(F.broadcast(W.daily_windows(spark, "2024-01-01", "2024-01-30", 0, 2)))
    found = W.reduce_windows(steps.select("user_id", "time", "value"), windows, ["sum"], ["user_id", "day", "window_start", "window_end"], ["user_id"])
    return found.select("user_id", "day", "n_steps", "n_present")


@query("""with s as (select user_id, event_id, lag(ts) over (partition by user_id order by ts) as a, ts as b from events),
l as (select user_id, d as "time" from (select distinct user_id from events), generate_series(timestamp '2024-01-02', timestamp '2024-01-29', interval 6 hour) t(d))
select l.user_id, l.time, s.event_id from l left join s on s.user_id = l.user_id and l.time > s.a and l.time <= s.b""")
def asof_containing_step(spark, sf):
    steps = _with_starts(_steps(spark, sf)).where("timestep_start is not null").select("user_id", "event_id", "timestep_start", F.col("time").alias("timestep_end"))
    stamps = spark.sql("select explode(sequence(timestamp_ntz'2024-01-02 00:00:00', timestamp_ntz'2024-01-29 00:00:00', interval 6 hours)) as time")
    labels = table(spark, sf, "events").select("user_id").distinct().crossJoin(F.broadcast(stamps))
    return W.as_of(labels, steps, ["user_id"]).select("user_id", "time", "event_id")


@query("""select user_id, round(sum(value), 6) as "sum", round(arg_min(value, ts), 6) as "first", round(arg_max(value, ts), 6) as "last", min(ts) as first_time, max(ts) as last_time
from events group by 1""")
def whole_run_reduce(spark, sf):
    return rounded(W.whole_run(_steps(spark, sf), ["user_id"], ["sum", "first", "last"]))


@query(f"""with w as ({_DAYS}), e as (select ts, user_id, lag(ts) over (partition by user_id order by ts) as a from events)
select day, min(a) as span_start, max(ts) as span_end, cast(sum(epoch_us(ts) - epoch_us(a)) as bigint) as span_micros from w join e on ts > window_start and ts <= window_end where a is not null group by 1""")
def window_span(spark, sf):
    steps = _with_starts(_steps(spark, sf)).where("timestep_start is not null")
    return W.window_span(steps, W.daily_windows(spark, "2024-01-01", "2024-01-31", 6, 18), ["day"])


@query("""select l_suppkey, round(sqrt(avg(l_tax * l_tax) / count(*) + pow(avg(sqrt(greatest(l_discount * l_discount - l_tax * l_tax, 0))), 2)), 9) as sd
from lineitem group by 1""")
def window_noise_sd(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(sampled_error(F.col("l_tax"), F.col("l_discount")).alias("sd")), 9)


@query(f"""select user_id, ts::date as day, round(avg(value), 6) as "mean", round(avg(case when event_type <> 'error' then 1.0 else 0.0 end), 6) as measured
from events group by 1, 2 having avg(case when event_type <> 'error' then 1.0 else 0.0 end) >= 0.5""")
def well_measured_windows(spark, sf):
    from fieldloom.operators.select import well_measured

    steps = _steps(spark, sf).withColumn("day", F.col("time").cast("date"))
    return rounded(well_measured(steps, ["user_id", "day"], F.col("event_type") != "error", 0.5, "value"))


@query("""with y as (select distinct year(o_orderdate) as y from orders), w as (select y as "year", make_timestamp(y, 1, 1, 0, 0, 0) as a, make_timestamp(y + 1, 1, 1, 0, 0, 0) as b from y),
rec as (select min(o_orderdate) as ra, max(o_orderdate) as rb from orders)
select "year"::int as "year", a as window_start, b as window_end from w, rec where a < ra or b > rb""")
def annual_windows_outside_record(spark, sf):
    orders = table(spark, sf, "orders")
    years = orders.select(F.year("o_orderdate").alias("year")).distinct()
    record = orders.agg(F.min("o_orderdate").alias("record_start"), F.max("o_orderdate").alias("record_end")).withColumn("k", F.lit(1))
    return W.outside_record(W.annual_windows(years).withColumn("k", F.lit(1)), record, ["k"]).select("year", "window_start", "window_end")


@query(f"""select user_id, {_CELL} as cell, round(sum(case when event_type = 'purchase' then value else 0 end), 6) as flux, round(arg_max(value, ts), 6) as pool, round(avg(value), 6) as rate
from events group by 1, 2""")
def run_cells_by_kind(spark, sf):
    wide = _steps(spark, sf).select("user_id", "time", F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("flux"), F.col("value").alias("pool"), F.col("value").alias("rate"))
    return rounded(W.aggregate_run(wide, ["user_id"], "1D", {"flux": "total", "pool": "end_state", "rate": "mean"}))


@query("""select event_id, user_id, ts - to_hours(cast(user_id % 24 as int) - 12) as "time" from events""")
def local_to_utc(spark, sf):
    steps = _steps(spark, sf)
    offsets = steps.select("user_id").distinct().select("user_id", (F.pmod("user_id", F.lit(24)) - 12).cast("double").alias("utc_offset_hours"))
    return W.to_utc(steps.select("event_id", "user_id", "time"), offsets, ["user_id"], HOUR).select("event_id", "user_id", "time")


@query(f"""select user_id, {_CELL} as cell, round(sum(value), 6) as "sum", count(*) as n_steps, count(value) as n_present
from events group by 1, 2""")
def cell_sum_streaming(spark, sf):
    """The daily cells of ``cell_sum_daily`` from a file stream: the same rows, with a watermark for late events."""
    from fieldloom.streaming.cells import run_once

    return rounded(run_once(spark, f"{sf}/events.parquet", ["user_id"], "ts", "value", "1D", "sum"))
