"""Ensemble summaries, rules, simulator fan-out and predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from fieldloom.operators import ensemble as E
from fieldloom.operators import rules as P
from fieldloom.queries import query, rounded
from fieldloom.session import table


@query("""select l_returnflag, l_linestatus, count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(median(l_extendedprice), 4) as median, round(stddev_pop(l_extendedprice), 4) as sd,
round(quantile_cont(l_extendedprice, 0.05), 4) as q05, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.95), 4) as q95 from lineitem group by 1, 2""")
def ensemble_quantiles(spark, sf):
    return rounded(E.summarise(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"), 4)


@query("""with b as (select l_partkey, quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.75) as b, quantile_cont(l_quantity, 0.05) as c, quantile_cont(l_quantity, 0.95) as d from lineitem group by 1)
select p_brand, count(*) as n, round(avg(case when p_size between a and b then 1.0 else 0.0 end), 6) as inside50, round(avg(case when p_size between c and d then 1.0 else 0.0 end), 6) as inside90
from part join b on l_partkey = p_partkey group by 1""")
def interval_coverage_50_90(spark, sf):
    predictions = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_quantity").alias("prediction"))
    observed = table(spark, sf, "part").select(F.col("p_partkey").alias("site"), "p_brand", F.col("p_size").cast("double").alias("value"))
    # ends of intervals such as 0.05 differ in their last digits; they are rounded before they are compared
    return rounded(E.coverage(predictions, observed, ["site"], by=["p_brand"]))


@query("""with m as (select l_linenumber, year(l_shipdate) as y, l_suppkey, avg(l_quantity) as m from lineitem group by 1, 2, 3)
select l_linenumber, y::int as year, count(*) as members, round(quantile_cont(m, 0.1), 6) as q10, round(quantile_cont(m, 0.9), 6) as q90 from m group by 1, 2""")
def two_level_quantiles(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return rounded(E.two_level_quantiles(items, "l_suppkey", ["l_linenumber", "year"], "l_quantity", [0.1, 0.9]))


@query("""select p_partkey, p_size / 50.0 as share, round(p_retailprice * 0.7 * (1 - p_size / 100.0) / 0.76, 6) as a_max, round((p_size / 100.0) * 0.76 / (1 - p_size / 100.0), 9) as base_fol_resp_frac,
case when p_type in ('ECONOMY', 'SMALL') then 0.0 else round(1000 * p_retailprice / 270.0, 6) end as lai_init, case p_type when 'ECONOMY' then 1.0 when 'SMALL' then 2.0 else 3.0 end as decay from part""")
def rule_projection(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 50.0).alias("share"), (F.col("p_size") / 100.0).alias("rho"), F.col("p_retailprice").alias("capacity"), F.lit(0.7).alias("leaf_c_per_area"), F.lit(0.76).alias("a_max_fraction"),
        F.col("p_type").alias("pft"), F.col("p_retailprice").alias("leaf_carbon"), F.lit(270.0).alias("leaf_per_area"), F.col("p_type").isin("ECONOMY", "SMALL").alias("deciduous"),
    )
    kinds = [r[0] for r in part.select("pft").distinct().collect()]
    rules = [P.copy("share", "share"), *P.photosynthesis("capacity", "rho"), P.initial_state("leaf_per_area", "f", "g", "deciduous")[2], P.fixed_by("decay", "pft", {k: {"ECONOMY": 1.0, "SMALL": 2.0}.get(k, 3.0) for k in kinds})]
    out = P.apply(part, rules, ["p_partkey"])
    return out.select("p_partkey", "share", F.round("a_max", 6).alias("a_max"), F.round("base_fol_resp_frac", 9).alias("base_fol_resp_frac"), F.round("lai_init", 6).alias("lai_init"), "decay")


def recurrence(parameters, forcing: pd.DataFrame) -> pd.DataFrame:
    """A small simulator: a pool that decays and gains the forcing at each step."""
    if parameters["decay"] >= 1:
        raise E.ModelFailure("the pool never decays")
    pool, total = parameters["start"], 0.0
    for x in forcing["gain"] if len(forcing) else ():
        pool = pool * parameters["decay"] + x
        total += x
    return pd.DataFrame({"pool": [pool], "gain": [total]})


def _fan_out_parts(spark, sf, parts):
    runs = parts.select(F.col("p_partkey").alias("sample"), F.pmod("p_partkey", F.lit(5)).alias("site"), (F.col("p_size") / 40.0).alias("decay"), F.col("p_retailprice").alias("start"))
    forcing = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("site"), "n_nationkey", F.col("n_nationkey").cast("double").alias("gain"))
    out = E.fan_out(runs, recurrence, forcing, ["sample", "site"], ["decay", "start"], "site", "n_nationkey", "pool double, gain double")
    return rounded(out.select("sample", "site", "pool", "gain", "status"))


@query("""with f as (select n_regionkey, n_nationkey, n_nationkey::double as gain, row_number() over (partition by n_regionkey order by n_nationkey desc) - 1 as back, count(*) over (partition by n_regionkey) as n from nation),
r as (select p_partkey as sample, p_size / 40.0 as decay, p_retailprice as start, p_partkey % 5 as site from part)
select sample, site, case when decay < 1 then round(start * pow(decay, max(n)) + sum(gain * pow(decay, back)), 6) end as pool, case when decay < 1 then sum(gain) end as gain, case when decay < 1 then 'ok' else 'failed' end as status
from r join f on n_regionkey = site group by sample, site, decay, start""")
def run_fanout_toy(spark, sf):
    return _fan_out_parts(spark, sf, table(spark, sf, "part"))


def _failures_of(parts):
    runs = parts.select(F.col("p_partkey").alias("sample"), (F.col("p_size") / 40.0).alias("decay"), F.col("p_retailprice").alias("start"))
    return E.failure_summary(E.fan_out(runs, recurrence, None, ["sample"], ["decay", "start"], "sample", "sample", "pool double, gain double"), ["sample"])


@query("""select 'ModelFailure' as error, 'the pool never decays' as message, count(*) as runs from part where p_size >= 40 having count(*) > 0""")
def failure_summary(spark, sf):
    return _failures_of(table(spark, sf, "part"))


@query("""select p_brand, bool_and(p_size < 40) as valid from part group by 1""")
def run_validity(spark, sf):
    results = table(spark, sf, "part").select("p_brand", F.when(F.col("p_size") < 40, "ok").otherwise("failed").alias("status"))
    return E.validity(results, "p_brand")


@query("""select o_orderkey as site, o_totalprice as value, round(median(l_extendedprice), 6) as median, round(o_totalprice - median(l_extendedprice), 6) as residual from orders join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def residual_from_median(spark, sf):
    from fieldloom.operators.analytics import residuals_from_median

    predictions = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_extendedprice").alias("prediction"))
    observed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), F.col("o_totalprice").alias("value"))
    return rounded(residuals_from_median(predictions, observed, ["site"]))


@query("""with e as (select user_id, ts, value, lag(ts) over (partition by user_id order by ts) as a from events), s as (select * from e where a is not null),
w as (select user_id, d::timestamp as b, d - interval 1 day as a from (select distinct user_id from events), generate_series(timestamp '2024-01-10', timestamp '2024-01-20', interval 5 day) t(d))
select 'flux' as source, w.user_id as site, w.b as "time", round(sum(s.value) , 6) as prediction from w join s on s.user_id = w.user_id and s.ts > w.a and s.ts <= w.b group by 2, 3
union all select 'run', user_id, null, round(max(value) * 0.01, 6) from s group by user_id""")
def observation_predictions(spark, sf):
    """Two sources: totals in daily windows and a maximum over the whole record, in one table of predictions."""
    from pyspark.sql import Window

    from fieldloom.operators import observe as O

    events = table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("ts").alias("time"), F.col("value").alias("flux"))
    output = events.withColumn("timestep_start", F.lag("time").over(Window.partitionBy("site").orderBy("time"))).where("timestep_start is not null")
    stamps = spark.sql("select explode(sequence(timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-20 00:00:00', interval 5 days)) as time")
    sites = output.select("site").distinct()
    dated = sites.crossJoin(F.broadcast(stamps)).select(F.lit("flux").alias("source"), "site", "time", (F.col("time") - F.expr("interval 1 day")).alias("window_start"), F.col("time").alias("window_end"))
    static = sites.select(F.lit("run").alias("source"), "site", *(F.lit(None).cast("timestamp_ntz").alias(c) for c in ("time", "window_start", "window_end")))
    operators = {"flux": O.ReduceOverWindows("flux", "sum"), "run": O.ReduceOverRun("flux", "max", O.unit_factor("g m-2", "Mg ha-1"))}
    failed = dated.join(output.select("site", F.col("time").alias("t")), "site").groupBy("site", "window_end").agg(F.count_if((F.col("t") > F.col("window_start")) & (F.col("t") <= F.col("window_end"))).alias("n")).where("n = 0")
    found = O.predict(operators, output, dated.unionByName(static), [], failed.select("site"))
    return rounded(found.where("prediction is not null"))


_OUTPUT = """e as (select user_id, ts, value, lag(ts) over (partition by user_id order by ts, event_id) as a from events), s as (select * from e where a is not null and a < ts),
w as (select user_id, d::timestamp as b, d - interval 1 day as a from (select distinct user_id from s), generate_series(timestamp '2024-01-10', timestamp '2024-01-20', interval 5 day) t(d))"""


def _output(spark, sf):
    """Steps of each user as a run's output, and a day's window before each of three stamps as observations."""
    from pyspark.sql import Window

    events = table(spark, sf, "events").select("event_id", F.col("user_id").alias("site"), F.col("ts").alias("time"), F.col("value").alias("flux"))
    steps = events.withColumn("timestep_start", F.lag("time").over(Window.partitionBy("site").orderBy("time", "event_id"))).where("timestep_start < time").drop("event_id")
    stamps = spark.sql("select explode(sequence(timestamp_ntz'2024-01-10 00:00:00', timestamp_ntz'2024-01-20 00:00:00', interval 5 days)) as time")
    observed = steps.select("site").distinct().crossJoin(F.broadcast(stamps)).select("site", "time", (F.col("time") - F.expr("interval 1 day")).alias("window_start"), F.col("time").alias("window_end"))
    return steps, observed


@query(f"""with {_OUTPUT} select w.user_id as site, w.b as "time", round(s.value, 6) as prediction from w left join s on s.user_id = w.user_id and s.a < w.b and w.b <= s.ts""")
def observation_timestep(spark, sf):
    """The step that holds each stamp."""
    from fieldloom.operators import observe as O

    steps, observed = _output(spark, sf)
    return rounded(O.SelectTimestep("flux").predict(steps, observed, []))


@query(f"""with {_OUTPUT} select w.user_id as site, w.b as "time", round(s.value / (1 + w.user_id % 7), 6) as prediction from w left join s on s.user_id = w.user_id and s.a < w.b and w.b <= s.ts""")
def observation_leaf_area(spark, sf):
    """Leaf carbon at each stamp over a parameter of the site."""
    from fieldloom.operators import observe as O

    steps, observed = _output(spark, sf)
    area = steps.select("site").distinct().withColumn("leaf_carbon_per_area", 1.0 + F.col("site") % 7)
    return rounded(O.LeafAreaIndex("flux").predict(steps, observed, [], area))


_DAYS = "((epoch_us(s.ts) - epoch_us(s.a)) / 86400e6)"


@query(f"""with {_OUTPUT} select w.user_id as site, w.b as "time", round(sum(s.value) / sum({_DAYS}), 6) as prediction from w left join s on s.user_id = w.user_id and s.ts > w.a and s.ts <= w.b group by 1, 2""")
def observation_average_rate(spark, sf):
    """The mean daily rate over each window of totals by step."""
    from fieldloom.operators import observe as O

    steps, observed = _output(spark, sf)
    return rounded(O.AverageRate("flux").predict(steps, observed, []))


@query(f"""with {_OUTPUT} select w.user_id as site, w.b as "time", round(sum(s.value * {_DAYS}) / sum({_DAYS}) / 0.48, 6) as prediction from w left join s on s.user_id = w.user_id and s.ts > w.a and s.ts <= w.b group by 1, 2""")
def observation_biomass(spark, sf):
    """Wood carbon averaged over each window by step length, as dry biomass."""
    from fieldloom.operators import observe as O

    steps, observed = _output(spark, sf)
    return rounded(O.AbovegroundBiomass(0.48, "flux").predict(steps, observed, []))


@query("""select 0::bigint as sample, user_id, ts, value as click, null::double as view from events where event_type = 'click' union all select 1, user_id, ts, null, value from events where event_type = 'view'""")
def stacked_runs(spark, sf):
    """Runs with other times and variables as one table."""
    events = table(spark, sf, "events")
    return E.stack_outputs({i: events.where(F.col("event_type") == t).select("user_id", "ts", F.col("value").alias(t)) for i, t in enumerate(("click", "view"))}).select("sample", "user_id", "ts", "click", "view")


@query("""select vec_id, round(ln(embedding[1]::double), 9) as density from embeddings where embedding[1] > 0 order by vec_id limit 40""")
def first_finite_draws(spark, sf):
    """The first draws in order whose density is finite."""
    from fieldloom.operators.reshape import first_finite

    v = F.col("embedding")[0].cast("double")
    draws = table(spark, sf, "embeddings").select("vec_id", F.when(v > 0, F.log(v)).otherwise(F.lit(float("-inf"))).alias("density"))
    return rounded(first_finite(draws, "vec_id", F.col("density"), 40), 9)


_STATES = """t as (select p_partkey as sample, p_brand as site, p_size / 10.0 as soil_organic_carbon, p_retailprice / 100 as wood_carbon, case when p_size % 7 > 0 then p_size / 50.0 - 0.1 end as leaf_carbon, p_size * 2.1 as soil_moisture,
case when p_size % 11 > 0 then 200.0 + p_size else 1e-7 end as leaf_per_area, p_size / 60.0 as fine, 0.25 as coarse, p_type in ('ECONOMY', 'SMALL') as deciduous from part),
r as (select *, case when not deciduous and (leaf_carbon is null or leaf_carbon < 0) then 'leaf_carbon is negative or not finite' when soil_moisture > 100 then 'soil_moisture is no percentage'
when leaf_per_area < 1e-6 then 'leaf_per_area is below the simulator''s least' when 1 - fine - coarse < 0.01 then 'roots take all wood' end as reason from t)"""


def _states(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample"), F.col("p_brand").alias("site"), (size / 10.0).alias("soil_organic_carbon"), (F.col("p_retailprice") / 100).alias("wood_carbon"), F.when(size % 7 > 0, size / 50.0 - 0.1).alias("leaf_carbon"),
        (size * 2.1).cast("double").alias("soil_moisture"), F.when(size % 11 > 0, 200.0 + size).otherwise(1e-7).alias("leaf_per_area"), (size / 60.0).alias("fine"), F.lit(0.25).alias("coarse"), F.col("p_type").isin("ECONOMY", "SMALL").alias("deciduous"),
    )


@query(f"with {_STATES} select sample, reason from r where reason is not null")
def refused_initial_states(spark, sf):
    """Rows that no initial state can be made of; deciduous sites don't need their leaf carbon."""
    return P.refused_states(_states(spark, sf), ["sample"], "leaf_per_area", "fine", "coarse", "deciduous")


@query(f"""with {_STATES} select sample, site, round(1000 * soil_organic_carbon, 6) as soil_init, round(1000 * wood_carbon / (1 - fine - coarse), 6) as plant_wood_init, case when deciduous then 0.0 else round(1000 * leaf_carbon / leaf_per_area, 6) end as lai_init,
round(soil_moisture / 100, 6) as soil_wfrac_init, round(fine, 6) as fine_root_frac, coarse::double as coarse_root_frac from r where reason is null""")
def member_initial_states(spark, sf):
    """Initial states of an ensemble, its pools matched with the parameters of the same sample."""
    rows = _states(spark, sf)
    good = rows.join(P.refused_states(rows, ["sample"], "leaf_per_area", "fine", "coarse", "deciduous").select("sample"), "sample", "left_anti")
    pools = good.select("sample", "site", "soil_organic_carbon", "wood_carbon", "leaf_carbon", "soil_moisture", "deciduous")
    parameters = good.select("sample", "leaf_per_area", "fine", "coarse")
    return rounded(P.member_states(pools, parameters, ["sample", "site"], "leaf_per_area", "fine", "coarse", "deciduous"))


@query("""select p_partkey, p_size / 100.0 as first, 0.3::double as second, round(p_retailprice * p_size / 100.0, 6) as total from part""")
def rule_simplex_compute(spark, sf):
    """A simplex copied to two outputs, and a formula that reads one of them by its argument's name."""

    def total(price, first):
        return price * first

    share = F.col("p_size") / 100.0
    part = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.array(share, F.lit(0.3), 0.7 - share).alias("parts"))
    out = P.apply(part, [*P.simplex(["first", "second"], "parts"), P.compute("total", total)], ["p_partkey"])
    return rounded(out)
