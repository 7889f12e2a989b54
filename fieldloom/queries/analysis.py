"""Residual time series over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions.time import iso_week
from fieldloom.operators import analytics as A
from fieldloom.queries import query, rounded
from fieldloom.session import table

_DAILY = "select o_orderpriority as k, o_orderdate::date as day, avg(o_totalprice) / 1013.0 as v from orders group by 1, 2"
_WEEK = "least((dayofyear(day) - 1) // 7 + 1, 52)"


def _daily(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("day")).agg((F.avg("o_totalprice") / 1013.0).alias("v"))


@query(f"""with d as ({_DAILY}) select k, count(v) as n, round(avg(v), 9) as mean, round(var_samp(v), 9) as variance, round(sqrt(greatest(var_samp(v) - 100, 0)), 9) as excess_sd from d group by 1""")
def residual_summary(spark, sf):
    return rounded(A.residual_summary(_daily(spark, sf).withColumn("sd", F.lit(10.0)), ["k"], "v", "sd"), 9)


@query(f"""with d as ({_DAILY}) select k, {", ".join(f"round(avg(case when (month(day) % 12) // 3 = {i} then v end), 9) as {n}" for i, n in enumerate(("djf", "mam", "jja", "son")))} from d group by 1""")
def seasonal_means(spark, sf):
    return rounded(A.seasonal_means(_daily(spark, sf), ["k"], "day", "v"), 9)


_YEARS = range(1995, 2002)  # of the SQL; the queries take the years of the record


def _pivot(daily, week=None):
    years = sorted(r[0] for r in daily.select(F.year("day")).distinct().collect())  # a row a year
    return rounded(A.weekly_by_year(daily, "day", "v", years, *([] if week is None else [week])), 9)


@query(f"""with d as ({_DAILY}) select w::int as week, {", ".join(f"round(avg(case when year(day) = {y} then v end), 9) as y{y}" for y in _YEARS)}
from generate_series(1, 52) t(w) left join d on {_WEEK} = w group by 1""")
def weekly_year_pivot(spark, sf):
    return _pivot(_daily(spark, sf))


@query(f"""with d as ({_DAILY}) select w::int as week, {", ".join(f"round(avg(case when year(day) = {y} then v end), 9) as y{y}" for y in _YEARS)}
from generate_series(1, 52) t(w) left join d on least(weekofyear(day), 52) = w group by 1""")
def iso_week_year_pivot(spark, sf):
    return _pivot(_daily(spark, sf), iso_week(F.col("day")))


@query(f"with d as ({_DAILY}) select year(day)::int as year, {_WEEK}::int as week, round(avg(v), 9) as mean from d group by 1, 2")
def weekly_year_means(spark, sf):
    return rounded(A.weekly_means(_daily(spark, sf), [], "day", "v"), 9)


@query(f"with d as ({_DAILY}) select year(day)::int as year, least(weekofyear(day), 52)::int as week, round(avg(v), 9) as mean from d group by 1, 2")
def iso_week_year_means(spark, sf):
    return rounded(A.weekly_means(_daily(spark, sf), [], "day", "v", iso_week(F.col("day"))), 9)


@query(f"""with d as ({_DAILY}), w as (select k, year(day) as y, {_WEEK} as w, avg(v) as m from d group by 1, 2, 3),
o as (select k, y, m, (sum(m) over (partition by k, w) - m) / nullif(count(m) over (partition by k, w) - 1, 0) as o from w)
select k, y::int as year, round(corr(m, o), 9) as correlation, count(*) as n from o where o is not null group by 1, 2 having count(*) > 10""")
def leave_one_out_year_corr(spark, sf):
    return rounded(A.year_correlations(A.weekly_means(_daily(spark, sf), ["k"], "day", "v"), ["k"]), 9)


_GRID = f"""d as ({_DAILY}), g as (select k, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from d group by k),
f as (select g.k, g.day, v from g left join d on d.k = g.k and d.day = g.day),
s as (select k, day, v, case when count(v) over w >= 5 then avg(v) over w end as slow from f window w as (partition by k order by day rows between 15 preceding and 15 following))"""


@query(f"with {_GRID} select k, day, round(v, 9) as v, round(slow, 9) as slow, round(v - slow, 9) as fast from s")
def centered_running_mean(spark, sf):
    return rounded(A.running_mean(A.daily_grid(_daily(spark, sf), ["k"], "day", "v"), ["k"], "day", "v"), 9)


@query(f"with {_GRID} select k, round(var_samp(v), 6) as variance, round(var_samp(slow), 6) as slow_variance, round(var_samp(v - slow), 6) as fast_variance, count(v) as n from s group by 1")
def variance_split(spark, sf):
    return rounded(A.variance_split(A.running_mean(A.daily_grid(_daily(spark, sf), ["k"], "day", "v"), ["k"], "day", "v"), ["k"], "v"), 6)


@query(f"""with d as ({_DAILY}), l as (select unnest([1, 2, 5, 10, 30])::int as lag)
select a.k, lag, round(corr(a.v, b.v), 9) as correlation, count(*) as n from d a, l, d b where b.k = a.k and b.day = a.day + lag group by 1, 2""")
def autocorr_lags(spark, sf):
    return rounded(A.autocorrelation(_daily(spark, sf), ["k"], "day", "v", [1, 2, 5, 10, 30]), 9)


_SMOOTH = f"""d as ({_DAILY}), w as (select k, {_WEEK} as week, avg(v) as m from d group by 1, 2),
s as (select k, (week - 1 + j + 52) % 52 + 1 as week, avg(m) as smooth from w, generate_series(-2, 2) t(j) group by 1, 2)"""


@query(f"with {_SMOOTH} select k, week::int as week, round(smooth, 9) as smooth from s")
def circular_smooth(spark, sf):
    from fieldloom.functions.time import week_of_year

    weekly = _daily(spark, sf).groupBy("k", week_of_year(F.col("day")).alias("week")).agg(F.avg("v").alias("mean"))
    return rounded(A.circular_smooth(weekly, ["k"], "week", "mean"), 9)


@query(f"with {_SMOOTH} select d.k, day, round(v, 9) as v, round(smooth, 9) as recurring, round(v - smooth, 9) as remainder from d left join s on s.k = d.k and s.week = {_WEEK}")
def recurring_part(spark, sf):
    return rounded(A.recurring_part(_daily(spark, sf), ["k"], "day", "v").select("k", "day", "v", "recurring", "remainder"), 9)


@query("""select event_id, round((coalesce(lag(value) over (partition by user_id order by ts), value) + value) / 2, 9) as step_mean from events""")
def step_mean_lag(spark, sf):
    return rounded(A.step_means(table(spark, sf, "events"), ["user_id"], "ts", "value").select("event_id", "step_mean"), 9)


@query("""with recursive e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts) as n from events),
s0 as (select user_id, avg(value) as s from e where n <= 8 group by 1),
f as (select e.event_id, e.user_id, e.n, s0.s + (e.value - s0.s) / 8.0 as s from e join s0 using (user_id) where n = 1
union all select e.event_id, e.user_id, e.n, f.s + (e.value - f.s) / 8.0 from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select event_id, round(s, 9) as filtered from f""")
def causal_ema(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rounded(A.exponential_filter(events, ["user_id"], ["ts"], "value", 8.0, 8).select("event_id", "filtered"), 9)


@query("""select o_orderpriority, year(o_orderdate)::int as "year", round(sum(o_totalprice * 2), 4) as total, count(*) as n from orders group by 1, 2 having count(o_totalprice) = count(*) and count(*) >= 0.99 * 300""")
def annual_complete_total(spark, sf):
    orders = table(spark, sf, "orders")
    return rounded(A.annual_totals(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", F.lit(2.0), F.lit(300)), 4)


@query("""with s as (select user_id % 10 as k, hour(ts)::bigint as slot, avg(case when event_type in ('click', 'view') then value end) as a, avg(case when event_type in ('purchase', 'signup') then value end) as b from events group by 1, 2),
p as (select x.k, lag, corr(x.a, y.b) as c from s x, generate_series(-4, 4) t(lag), s y where y.k = x.k and x.slot = (y.slot + lag + 24) % 24 group by 1, 2)
select k, lag::int as lag, round(c, 9) as correlation from (select *, row_number() over (partition by k order by c desc, abs(lag), lag) as n from p) where n = 1""")
def diurnal_lag(spark, sf):
    events = table(spark, sf, "events")
    slots = events.groupBy(F.pmod("user_id", F.lit(10)).alias("k"), F.hour("ts").cast("long").alias("slot")).agg(
        F.avg(F.when(F.col("event_type").isin("click", "view"), F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type").isin("purchase", "signup"), F.col("value"))).alias("b")
    )
    return rounded(A.best_lag(slots, ["k"], "slot", "a", "b", list(range(-4, 5)), 24).select("k", "lag", "correlation"), 9)


@query("""with d as (select ts::date as day, avg(case when event_type = 'click' then value end) as a, avg(case when event_type = 'view' then value end) as b from events group by 1),
n as (select day - date '2024-01-01' as i, a, b from d), p as (select lag, corr(x.a, y.b) as c from n x, generate_series(-10, 10) t(lag), n y where x.i = y.i + lag group by 1)
select 1 as k, lag::int as lag, round(c, 9) as correlation from p order by c desc, abs(lag), lag limit 1""")
def daily_lead_lag(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    indexed = daily.select(F.lit(1).alias("k"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("i"), "a", "b")
    return rounded(A.best_lag(indexed, ["k"], "i", "a", "b", list(range(-10, 11))).select("k", "lag", "correlation"), 9)
