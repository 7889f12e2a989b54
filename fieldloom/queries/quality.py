"""Data-quality assertions and surveys: violating rows and figures of the carrier tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import checks as C
from fieldloom.queries import query, rounded
from fieldloom.session import table


@query("""select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2 having count(*) > 1""")
def check_repeated_keys(spark, sf):
    return C.repeated_keys(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("""select distinct o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""")
def check_unknown_keys(spark, sf):
    return C.unknown_keys(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("""select event_id from events where (event_type = 'error') <> (value > 50)""")
def check_missing_together(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", 1).alias("a"), F.when(F.col("value") <= 50, 1).alias("b"))
    return C.not_missing_together(rows, "a", "b").select("event_id")


@query("""select p_partkey from part where p_size % 10 = 0""")
def check_not_finite(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("v"))
    return C.not_finite(rows, ["v"]).select("p_partkey")


@query("""select c_custkey, c_mktsegment from customer where c_mktsegment not in ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def check_classes(spark, sf):
    return C.outside_classes(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY", "HOUSEHOLD"])


@query("""select user_id, false as passes from events group by 1 having not coalesce(bool_or(value > 250), false)""")
def check_never_passing(spark, sf):
    return C.never_passing(table(spark, sf, "events"), ["user_id"], F.col("value") > 250)


@query("""select o_orderkey from orders join (select l_orderkey, sum(l_extendedprice) as s from lineitem group by 1) on l_orderkey = o_orderkey where abs(o_totalprice - s) > 100000""")
def check_cross_table(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return C.apart(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), totals, ["o_orderkey"], ["o_totalprice"], 100_000.0).select("o_orderkey")


@query("""select n_nationkey, m as c_mktsegment from nation, (select distinct c_mktsegment as m from customer) where (n_nationkey, m) not in (select c_nationkey, c_mktsegment from customer where c_acctbal > 5000)""")
def check_rectangle(spark, sf):
    customer = table(spark, sf, "customer")
    rows = customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    return C.missing_cells(rows, [table(spark, sf, "nation").select("n_nationkey"), customer.select("c_mktsegment").distinct()])


@query("""select user_id, 'click' as variable from events group by 1 having count(case when event_type = 'click' then 1 end) between 1 and count(*) - 1""")
def check_uniform_presence(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("click"), "value")
    return C.uneven_presence(rows, ["user_id"], ["click", "value"])


@query("""with d as (select o_orderpriority as k, o_orderdate::date as day from orders group by 1, 2), l as (select k, day, day - lag(day) over (partition by k order by day) as gap from d)
select k, day, gap::bigint * 86400000000 as gap from l where gap <> 1""")
def check_gaps(spark, sf):
    from fieldloom.functions.time import DAY

    days = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return C.gaps_in_stamps(days, ["k"], F.unix_micros(F.col("day").cast("timestamp")), DAY)


@query("""select event_id, previous from (select event_id, value, lag(value) over (partition by user_id order by event_id) as previous from events) where value <= previous""")
def check_increasing(spark, sf):
    return C.not_increasing(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", "previous")


@query("""select l_orderkey, count(*) as n, min(l_linenumber) as lowest, max(l_linenumber) as highest, count(distinct l_linenumber) as distinct_ranks from lineitem group by 1
having min(l_linenumber) <> 1 or max(l_linenumber) <> count(*) or count(distinct l_linenumber) <> count(*)""")
def check_permutation(spark, sf):
    return C.not_a_permutation(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""select o_custkey, count(distinct o_orderstatus) as n from orders group by 1 having count(distinct o_orderstatus) > 1""")
def check_functional_map(spark, sf):
    return C.not_a_function(table(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


@query("""select k from generate_series((select min(l_orderkey) from lineitem), (select max(l_orderkey) from lineitem)) t(k) where k not in (select l_orderkey from lineitem)""")
def check_missing_ids(spark, sf):
    return C.missing_ids(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), "k")


@query("""select count(*) as n, 24 as expected from nation having count(*) <> 24""")
def check_row_count(spark, sf):
    return C.unexpected_count(table(spark, sf, "nation"), 24)


@query("""select o_orderkey, o_totalprice, 'lost' as side from orders where o_totalprice > 400000""")
def check_round_trip(spark, sf):
    before = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.round_trip(before, before.where("o_totalprice <= 400000"))


@query("""select 'value' as "column", count(*) as n, count(case when event_type = 'error' then 1 end) as missing, round(median(case when event_type <> 'error' then value end), 6) as median,
round(min(case when event_type <> 'error' then value end), 6) as "min", round(max(case when event_type <> 'error' then value end), 6) as "max", count(distinct case when event_type <> 'error' then user_id end) as keys_with_any from events""")
def column_survey(spark, sf):
    from fieldloom.operators.surveys import column_survey as survey

    rows = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return rounded(survey(rows, "user_id", ["value"]))


@query("""select event_type as value, count(*) as n, round(count(*) / (select count(*) from events)::double, 9) as share from events group by 1""")
def value_counts(spark, sf):
    from fieldloom.operators.surveys import value_counts as counts

    return rounded(counts(table(spark, sf, "events"), "event_type"), 9)


@query("""select l_orderkey, round(sum((l_linenumber - coalesce(p, 0)) * l_discount * 100), 6) as integral from
(select *, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as p from lineitem) group by 1""")
def profile_integral(spark, sf):
    from fieldloom.operators.surveys import profile_integral as integral

    return rounded(integral(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_linenumber", "l_discount", 100.0))


@query("""select year(o_orderdate)::int as year, month(o_orderdate)::int as month, count(distinct o_orderdate) as held, max(day(last_day(o_orderdate::date)))::int as possible, round(count(distinct o_orderdate) / max(day(last_day(o_orderdate::date)))::double, 6) as share
from orders group by 1, 2""")
def kept_fraction_by_month(spark, sf):
    from fieldloom.operators.surveys import kept_by_month

    return rounded(kept_by_month(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct(), "day"))


@query("""select count(*) as "rows", count(distinct p_brand) as keys, median(p_size - cast(floor(p_retailprice) as bigint) % 50) as median_excess from part where p_size >= cast(floor(p_retailprice) as bigint) % 50""")
def inversion_survey(spark, sf):
    from fieldloom.operators.surveys import inversions

    rows = table(spark, sf, "part").select("p_brand", "p_size", (F.floor("p_retailprice") % 50).alias("other"))
    return inversions(rows, "p_brand", "p_size", "other")


@query("""select count(*) as "rows", (select count(*) from (select distinct c_nationkey, c_mktsegment from customer)) as cells, count(distinct c_nationkey) as n_c_nationkey, count(distinct c_mktsegment) as n_c_mktsegment,
count(*) = (select count(*) from (select distinct c_nationkey, c_mktsegment from customer)) and count(*) = count(distinct c_nationkey) * count(distinct c_mktsegment) as complete from customer""")
def rectangle_completeness(spark, sf):
    from fieldloom.operators.surveys import completeness

    return completeness(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("""select vec_id, embedding[1] between -0.1 and 0.1 as within, embedding[1] > -0.1 and embedding[1] < 0.1 as inside, true as on_simplex, abs(embedding[1]) + abs(embedding[2]) between 1 - 1e-10 and 1 + 1e-10 as off_simplex from embeddings""")
def support_membership(spark, sf):
    from fieldloom.operators.select import in_interval, in_simplex

    x, y = F.abs(F.col("embedding")[0].cast("double")), F.abs(F.col("embedding")[1].cast("double"))
    v = F.col("embedding")[0]
    return table(spark, sf, "embeddings").select(
        "vec_id", in_interval(v, -0.1, 0.1).alias("within"), in_interval(v, -0.1, 0.1, closed=False).alias("inside"), in_simplex(F.array(x / (x + y), y / (x + y))).alias("on_simplex"), in_simplex(F.array(x, y)).alias("off_simplex")
    )


@query("""select o_orderkey, c_custkey, case when abs(c_acctbal) > 9000 then 1 else 0 end as rich from (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1 having count(distinct o_orderpriority) > 1) join customer on c_custkey = o_custkey""")
def check_not_constant(spark, sf):
    """Customers whose orders differ in their priority, with their first order."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    mixed = C.not_constant(orders, ["o_custkey"], ["o_orderpriority"]).select("o_custkey")
    first = orders.join(mixed, "o_custkey", "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return first.join(customer, "c_custkey").select("o_orderkey", "c_custkey", (F.abs("c_acctbal") > 9000).cast("int").alias("rich"))
