"""Selections, joins with key contracts, and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.operators import joins as J
from fieldloom.operators import reshape as R
from fieldloom.operators import select as S
from fieldloom.queries import query, rounded
from fieldloom.session import table

_IDS = [7, 3, 120, 44, 9, 61, 30]


@query(f"""select i as position, c_custkey as site_id, c_acctbal / 100 as lon, c_nationkey::double as lat from
(select unnest({_IDS}) as k, unnest(range({len(_IDS)}))::int as i) a join customer on c_custkey = k
where c_acctbal / 100 between -5 and 95 and c_nationkey between 1 and 23 and c_mktsegment <> 'MACHINERY'""")
def select_composed(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"), (F.col("c_acctbal") / 100).alias("lon"), F.col("c_nationkey").cast("double").alias("lat"), "c_mktsegment")
    found = S.select_sites(sites, ids=_IDS, box=(-5.0, 1.0, 95.0, 23.0), where=F.col("c_mktsegment") != "MACHINERY")
    return found.select("position", "site_id", "lon", "lat")


@query("""select c_custkey, c_name from customer order by md5('11|' || c_custkey), c_custkey limit 20""")
def select_random_sites(spark, sf):
    """A sample by the digest of seed and id: the same rows on any number of partitions."""
    return S.select_sites(table(spark, sf, "customer"), "c_custkey", n_random=20, seed=11).select("c_custkey", "c_name")


@query("""select i as position, n_nationkey, n_name from (select unnest([7, 3, 3, 24, 0]) as k, unnest(range(5))::int as i) a join nation on n_nationkey = k""")
def request_order_fetch(spark, sf):
    return J.request_order(table(spark, sf, "nation"), [7, 3, 3, 24, 0], "n_nationkey").select("position", "n_nationkey", "n_name")


@query("""select c_custkey, r_name, r_regionkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def lookup_join(spark, sf):
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    a = J.lookup(customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), nation, ["n_nationkey"])
    return J.lookup(a.withColumnRenamed("n_regionkey", "r_regionkey"), region, ["r_regionkey"]).select("c_custkey", "r_name", "r_regionkey")


@query("""with s as (select min(s_suppkey) as m, s_nationkey from supplier group by 2),
g as (select min(s_suppkey) as m, n_regionkey from supplier join nation on s_nationkey = n_nationkey group by 2),
e as (select c_custkey, s_suppkey as m from customer join supplier on s_suppkey = cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) as bigint) where s_acctbal > 0)
select c.c_custkey, coalesce(e.m, s.m, g.m) as match, case when e.m is not null then 'name' when s.m is not null then 'nation' when g.m is not null then 'region' end as basis
from customer c left join e using (c_custkey) left join s on s.s_nationkey = c.c_nationkey left join nation n on n.n_nationkey = c.c_nationkey left join g on g.n_regionkey = n.n_regionkey""")
def resolution_cascade(spark, sf):
    customer, supplier, nation = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    number = F.regexp_extract("c_name", "#0*([0-9]+)$", 1).cast("long")
    named = customer.select("c_custkey", number.alias("s_suppkey")).join(supplier.where("s_acctbal > 0"), "s_suppkey").select("c_custkey", F.col("s_suppkey").alias("match"))
    own = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("match"))
    region = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("match"))
    in_nation = customer.join(own, "c_nationkey").select("c_custkey", "match")
    in_region = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, "n_regionkey").select("c_custkey", "match")
    return J.cascade(customer.select("c_custkey"), "c_custkey", [("name", named), ("nation", in_nation), ("region", in_region)])


@query("""select o_custkey, o_orderdate, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1""")
def first_owner_per_cell(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return J.first_owner(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""select s_nationkey, s_suppkey, concat('balance ', cast(cast(floor(s_acctbal) as bigint) as varchar)) as reason, coalesce(losers, '') as losers from
(select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n from supplier) a
left join (select s_nationkey as k, string_agg(cast(s_suppkey as varchar), ',' order by n) as losers from
(select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as n from supplier) where n > 1 group by 1) b on k = s_nationkey where n = 1""")
def primary_choice_with_reason(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    reason = F.concat(F.lit("balance "), F.floor("s_acctbal").cast("string"))
    return J.primary_choice(supplier, ["s_nationkey"], [F.desc("s_acctbal"), F.col("s_suppkey")], "s_suppkey", reason).select("s_nationkey", "s_suppkey", "reason", "losers")


@query("""with a as (select l_linenumber as sample, sum(l_quantity) as q from lineitem group by 1), b as (select l_linenumber as sample, avg(l_discount) as d from lineitem group by 1)
select sample, r_regionkey, round(q * d * (1 + r_regionkey), 6) as product from a join b using (sample), region""")
def zip_cross_ensemble(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("sample"), "l_quantity", "l_discount")
    a, b = items.groupBy("sample").agg(F.sum("l_quantity").alias("q")), items.groupBy("sample").agg(F.avg("l_discount").alias("d"))
    zipped = J.zip_or_cross(a, b, ["sample"])
    crossed = J.zip_or_cross(zipped, table(spark, sf, "region").select("r_regionkey"), ["sample", "r_regionkey"])
    return rounded(crossed.select("sample", "r_regionkey", (F.col("q") * F.col("d") * (1 + F.col("r_regionkey"))).alias("product")))


@query("""with d as (select event_type, ts::date as day, avg(value) as m from events group by 1, 2)
select quarter(a.day)::int as quarter, round(avg(a.m - b.m), 6) as difference, count(*) as n from d a join d b on a.day = b.day where a.event_type = 'click' and b.event_type = 'view' group by 1""")
def inner_window_difference(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("mean"))
    first, second = (daily.where(F.col("event_type") == t).select("day", F.col("mean").alias(t)) for t in ("click", "view"))
    both = first.join(second, "day")
    return rounded(both.groupBy(F.quarter("day").alias("quarter")).agg(F.avg(F.col("click") - F.col("view")).alias("difference"), F.count("*").alias("n")))


@query("""with d as (select event_type, ts::date as day, sum(value) as v from events group by 1, 2)
select a.event_type, round(corr(a.v, b.v), 6) as correlation, count(*) as n from d a join d b on a.event_type = b.event_type and b.day = a.day + 1 group by 1""")
def next_period_pairs(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    pairs = J.next_period(daily, ["event_type"], "day", "v")
    return rounded(pairs.groupBy("event_type").agg(F.corr("v", "next_v").alias("correlation"), F.count("*").alias("n")))


@query("""select c_custkey as k, 'missing' as violation from customer where c_custkey not in (select o_custkey from orders)
union all select distinct o_custkey, 'unknown' from orders where o_custkey not in (select c_custkey from customer)""")
def coverage_violations(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return J.coverage(wanted, table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""select c_nationkey, any_value(n_name) as n_name, any_value(n_regionkey) as n_regionkey from customer join nation on c_nationkey = n_nationkey group by 1""")
def static_collapse(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return R.static_values(joined, ["c_nationkey"], ["n_name", "n_regionkey"])


@query("""with e as (select user_id, ts::date as day, sum(value) as v from events where event_type = 'purchase' group by 1, 2)
select u.user_id, d::date as day, round(v, 6) as total from (select distinct user_id from events) u cross join generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 1 day) t(d)
left join e on e.user_id = u.user_id and e.day = d::date""")
def dense_rectangle(spark, sf):
    events = table(spark, sf, "events")
    daily = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("total"))
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-30')) as day")
    return rounded(R.dense(daily, [events.select("user_id").distinct(), F.broadcast(days)], ["total"]))


@query("""with s as (select l_returnflag, l_linestatus, l_linenumber, row_number() over (order by l_returnflag, l_linestatus, l_linenumber) - 1 as stacked from (select distinct l_returnflag, l_linestatus, l_linenumber from lineitem))
select stacked, l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem join s using (l_returnflag, l_linestatus, l_linenumber) group by 1, 2, 3, 4""")
def stack_roundtrip(spark, sf):
    dims = ["l_returnflag", "l_linestatus", "l_linenumber"]
    cells = table(spark, sf, "lineitem").groupBy(*dims).agg(F.count("*").alias("n"))
    stacked, labels = R.stack(cells, dims, "stacked")
    return R.unstack(stacked, labels, "stacked").join(labels, dims).select("stacked", *dims, "n")


def _through_layout(embeddings):
    from fieldloom.plans.layout import Component, Layout

    layout = Layout([Component("a", elements=("x", "y")), Component("b", elements=("x", "y"))])
    vectors = embeddings.select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("flat"))
    again = layout.to_flat(layout.to_entries(vectors, ["vec_id"], "flat"), ["vec_id"], "flat")
    return layout.to_entries(again, ["vec_id"], "flat").select("vec_id", F.col("entry").cast("long").alias("entry"), "value")


@query("""select vec_id, i - 1 as entry, embedding[i]::double as value from embeddings, generate_series(1, 4) t(i)""")
def layout_roundtrip(spark, sf):
    return _through_layout(table(spark, sf, "embeddings"))


@query("""select p_partkey, concat('embedding.', case k when 0 then 'size' else 'price' end) as variable, case k when 0 then p_size::double else p_retailprice end as value from part, generate_series(0, 1) t(k)""")
def element_split(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("embedding"))
    return R.split_elements(part, ["p_partkey"], "embedding", ["size", "price"])


@query("""with s as (select distinct s_suppkey, (select count(*) from supplier) as n from supplier), k as (select distinct cast(round_even(i * (n - 1) / 6.0, 0) as bigint) as p from generate_series(0, 6) t(i), (select count(*) as n from supplier))
select s_suppkey from s where s_suppkey in (select p from k)""")
def thinned_members(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey")
    n = supplier.count()
    return R.thin(supplier, "s_suppkey", n, 7)


@query("""select row_number() over (order by o_orderkey) - 1 as position, o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderpriority from orders""")
def positions_in_order(spark, sf):
    return R.numbered(table(spark, sf, "orders"), ["o_orderkey"], "position").select("position", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def _enumerated(spark, sf, suppliers):
    regions = table(spark, sf, "nation").select("n_regionkey").distinct()
    return R.run_table(3, [regions], suppliers.select("s_suppkey"))


@query("""select sample, n_regionkey, s_suppkey, (row_number() over (order by sample, n_regionkey, s_suppkey) - 1) as run
from generate_series(0, 2) t(sample), (select distinct n_regionkey from nation), (select s_suppkey from supplier)""")
def run_enumeration(spark, sf):
    return _enumerated(spark, sf, table(spark, sf, "supplier"))


@query("""select event_id, user_id, ts from events where event_type in ('click', 'view') and user_id in (1, 2, 3, 5, 8) and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-21'""")
def observation_selection(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), F.col("user_id").alias("site"), F.col("ts").alias("time"))
    found = S.observations(rows, sources=["click", "view"], sites=[1, 2, 3, 5, 8], start="2024-01-05", end="2024-01-20")
    return found.select("event_id", F.col("site").alias("user_id"), F.col("time").alias("ts"))


@query("""select c_custkey, 'c_acctbal' as variable, c_acctbal as value from customer where c_acctbal < -500 or c_acctbal > 9000
union all select c_custkey, 'c_nationkey', c_nationkey::double from customer where c_nationkey > 20""")
def out_of_domain_report(spark, sf):
    return S.out_of_domain(table(spark, sf, "customer"), ["c_custkey"], {"c_acctbal": (-500.0, 9000.0), "c_nationkey": (None, 20.0)})


@query("""select event_type, count(*) as kept from events where event_type <> 'error' group by 1""")
def quality_filter(spark, sf):
    flagged = table(spark, sf, "events").withColumn("qc", F.when(F.col("event_type") == "error", "001").otherwise("000"))
    kept, _ = S.passing(flagged, "qc", "000")
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""select o_orderkey, o_totalprice * 2 as o_totalprice from orders""")
def replace_observed_values(spark, sf):
    held = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.replace_values(held, held.select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice")), ["o_orderkey"], "o_totalprice")
