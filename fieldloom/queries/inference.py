"""Densities, weighted populations, and the iterative samplers on problems with known answers."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from fieldloom.functions import density as D
from fieldloom.operators import weights as W
from fieldloom.queries import normal_sql, query, rounded
from fieldloom.session import table


@query("""select l_returnflag, l_linestatus, round(sum(-0.5 * (pow(l_quantity - 25, 2) / (100 + l_linenumber) + ln(100 + l_linenumber) + ln(2 * pi()))), 4) as log_density from lineitem group by 1, 2""")
def log_density_diag_gaussian(spark, sf):
    items = table(spark, sf, "lineitem")
    return rounded(items.groupBy("l_returnflag", "l_linestatus").agg(D.diagonal_gaussian(F.col("l_quantity") - 25, (100 + F.col("l_linenumber")).cast("double")).alias("log_density")), 4)


@query("""select p_partkey, round(-0.5 * pow((ln(p_retailprice) - ln(1000)) / ln(1.5), 2) - ln(ln(1.5)) - ln(2 * pi()) / 2 - ln(p_retailprice), 9) as log_normal,
round(2.0 * ln(3.0) - lgamma(2.0) - 3.0 * ln(p_size) - 3.0 / p_size, 9) as inverse_gamma, round(lgamma(p_size / 2.0), 8) as log_gamma from part""")
def log_density_families(spark, sf):
    size = F.col("p_size").cast("double")
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey", F.round(D.log_normal(F.col("p_retailprice"), 1000.0, 1.5), 9).alias("log_normal"), F.round(D.inverse_gamma(size, 2.0, 3.0), 9).alias("inverse_gamma"), F.round(D.log_gamma(size / 2), 8).alias("log_gamma")
    )


@query("""select l_suppkey, round(lgamma(3 + count(*) / 2.0) - lgamma(3) + 3 * ln(50) - count(*) / 2.0 * ln(2 * pi()) - (3 + count(*) / 2.0) * ln(50 + sum(pow(l_quantity - 25, 2)) / 2), 6) as log_density from lineitem group by 1""")
def student_t_groups(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col("l_quantity") - 25, 2)).alias("q"))
    return rounded(groups.select("l_suppkey", D.student_group(F.col("n"), F.col("q"), F.lit(0.0), 3.0, 50.0).alias("log_density")))


@query("""select l_suppkey, 2.0 + count(*) / 2.0 as a, round(10 + sum(pow(l_quantity - 25, 2) / 200) / 2, 6) as b from lineitem group by 1""")
def conjugate_scale_update(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("r", F.col("l_quantity") - 25)
    return rounded(W.scale_update(items, ["l_suppkey"], "r", F.lit(200.0), 2.0, 10.0))


@query("""select p_brand, round(exp(avg(ln(p_retailprice))), 6) as median, round(exp(stddev_pop(ln(p_retailprice))), 9) as geometric_sd from part group by 1""")
def log_normal_moments(spark, sf):
    found = W.log_moments(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return found.select("p_brand", F.round("median", 6).alias("median"), F.round("geometric_sd", 9).alias("geometric_sd"))


@query("""with t as (select label, max(lw) as a, max(lw + 0.3 * lr) as b, max(lw + 0.6 * lr) as c from (select label, embedding[1]::double as lw, 10 * embedding[2]::double as lr from embeddings) group by 1),
e as (select label, embedding[1]::double as lw, 10 * embedding[2]::double as lr from embeddings)
select label, round(pow(sum(exp(lw)), 2) / sum(exp(2 * lw)), 6) as ess, round(pow(sum(exp(lw + 0.3 * lr)), 2) / sum(exp(lw)) / sum(exp(lw + 0.6 * lr)), 6) as cess, round(ln(sum(exp(lw))), 6) as log_total from e group by 1""")
def ess_cess(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("lw"), (10 * F.col("embedding")[1].cast("double")).alias("lr"))
    return rounded(W.effective_sizes(rows, ["label"], "lw", "lr", 0.3))


@query("""with c as (select *, sum(value) over (order by event_id) as hi, sum(value) over () as t from events)
select d as draw, event_id, user_id, event_type, value, ts from c, generate_series(0, 199) g(d) where (0.37 + d) / 200 >= (hi - value) / t and (0.37 + d) / 200 < hi / t""")
def systematic_resample(spark, sf):
    return W.systematic_resample(table(spark, sf, "events"), "event_id", "value", 200, 0.37).select("draw", "event_id", "user_id", "event_type", "value", "ts")


@query("""with m as (select sum(l_tax * l_quantity) / sum(l_quantity) as ma, sum(l_discount * l_quantity) / sum(l_quantity) as mb, sum(l_quantity) as w, sum(l_quantity * l_quantity) / pow(sum(l_quantity), 2) as p2 from lineitem)
select round(any_value(ma), 9) as mean_l_tax, round(any_value(mb), 9) as mean_l_discount, round(sum(l_quantity / w * pow(l_tax - ma, 2)) / (1 - any_value(p2)), 9) as cov_l_tax_l_tax,
round(sum(l_quantity / w * (l_tax - ma) * (l_discount - mb)) / (1 - any_value(p2)), 9) as cov_l_tax_l_discount, round(sum(l_quantity / w * pow(l_discount - mb, 2)) / (1 - any_value(p2)), 9) as cov_l_discount_l_discount from lineitem, m""")
def weighted_moments(spark, sf):
    return rounded(W.weighted_moments(table(spark, sf, "lineitem").select("l_tax", "l_discount", "l_quantity"), ["l_tax", "l_discount"], "l_quantity"), 9)


@query("""with g as (select l_suppkey::varchar as source, count(*) as n, sum(pow(l_quantity - 25.5, 2) / 208.25) as q from lineitem group by 1
union all select 'all', count(*), sum(pow(l_quantity - 25.5, 2) / 208.25) from lineitem),
t as (select source, n, q, sum(exp((n / 2.0 + i) * ln(q / 2) - q / 2 - lgamma(n / 2.0 + i + 1))) as p from g, generate_series(0, 6000) s(i) group by 1, 2, 3)
select source, n, round(q / 2, 6) as misfit, round(greatest(0.0, 1 - p), 6) as p_value from t""")
def predictive_check(spark, sf):
    """Misfit of each supplier's quantities with a chi-square tail, and the same over all; its SQL sums the gamma series."""
    items = table(spark, sf, "lineitem")
    per = items.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("l_quantity") - 25.5, 2) / 208.25).alias("q")).withColumn("source", F.col("l_suppkey").cast("string")).drop("l_suppkey")
    both = per.unionByName(per.agg(F.sum("n").alias("n"), F.sum("q").alias("q")).withColumn("source", F.lit("all")))
    return rounded(both.select("source", "n", (F.col("q") / 2).alias("misfit"), D.chi_square_sf(F.col("q"), F.col("n")).alias("p_value")))


def _model():
    """A small model graph: two priors, a rule, an observation, and a factor that the observation doesn't read."""
    from fieldloom.plans import model as M

    return M.Model(
        [
            M.Factor("rate", lambda: M.log_normal_law(1.0, 1.5)),
            M.Factor("share", lambda: M.logit_normal_law(0.0, 1.0, 0.4, 0.5)),
            M.Deterministic("mean", lambda a, b: 100 * a * b, ("rate", "share")),
            M.Factor("y", lambda m: M.normal_law(m, 5.0), ("mean",)),
            M.Factor("unused", lambda: M.normal_law(0.0, 1.0)),
        ]
    )


@query("""with t as (select p_partkey as sample, p_retailprice / 1000 as rate, p_size / 60.0 as share from part),
d as (select *, -0.5 * pow(ln(rate) / ln(1.5), 2) - ln(ln(1.5)) - ln(2 * pi()) / 2 - ln(rate)
- 0.5 * pow((ln(share / (1 - share)) - ln(0.4 / 0.6)) / 0.5, 2) - ln(0.5) - ln(2 * pi()) / 2 - ln(share * (1 - share)) as a,
-0.5 * pow((42 - 100 * rate * share) / 5, 2) - ln(5) - ln(2 * pi()) / 2 as b from t)
select sample, round(a, 6) as log_prior, round(b, 6) as log_likelihood, round(a + b, 6) as log_density, true as valid from d""")
def model_posterior(spark, sf):
    """Prior, likelihood and density of parameter values given an observation, in one projection."""
    from fieldloom.plans import model as M

    posterior = M.Posterior(_model(), {"y": 42.0})
    theta = table(spark, sf, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_retailprice") / 1000).alias("rate"), (F.col("p_size") / 60.0).alias("share"))
    return rounded(posterior.evaluate(theta).select("sample", "log_prior", "log_likelihood", "log_density", "valid"))


def _draw_sql(name: str) -> str:
    return normal_sql(7 ^ crc32(name.encode()), "p_partkey")


@query(f"""with t as (select p_partkey as sample, exp(ln(1.5) * {_draw_sql('rate')}) as rate, 1 / (1 + exp(-(ln(0.4 / 0.6) + 0.5 * {_draw_sql('share')}))) as share, {_draw_sql('y')} as z from part)
select sample, round(rate, 6) as rate, round(share, 6) as share, round(100 * rate * share, 6) as mean, round(100 * rate * share + 5 * z, 6) as y from t""")
def model_draws(spark, sf):
    """Ancestral draws: each factor's stream is a digest of its name's seed and the sample, so SQL draws them too."""
    return rounded(_model().sample(table(spark, sf, "part").select(F.col("p_partkey").alias("sample")), 7).select("sample", "rate", "share", "mean", "y"))


@query(f"""select p_partkey as sample, round(100 * (p_retailprice / 1000) * (p_size / 60.0) + 5 * {_draw_sql('y')}, 6) as y_new from part""")
def posterior_replicates(spark, sf):
    """New observations given parameter values: a posterior predictive run."""
    from fieldloom.plans import model as M

    theta = table(spark, sf, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_retailprice") / 1000).alias("rate"), (F.col("p_size") / 60.0).alias("share"))
    return rounded(M.Posterior(_model(), {"y": 42.0}).replicate(theta, 7).select("sample", "y_new"))


def smc_estimates(spark, sf):
    """Estimate and exact value of the mean of the part prices and of the evidence, by tempered Monte Carlo."""
    from fieldloom.inference import smc as S

    stats = table(spark, sf, "part").agg(F.count("*").alias("n"), F.avg((F.col("p_retailprice") - 1000) / 100).alias("m")).first()
    n, m = stats["n"], stats["m"]

    def evaluate(frame):
        t = F.element_at("theta", 1)
        return frame.select("sample", (-0.5 * n * F.pow(t - m, 2)).alias("log_likelihood"))

    problem = S.Problem(lambda g, k: 3 * g.standard_normal((k, 1)), lambda x: -0.5 * (x[:, 0] / 3) ** 2 - np.log(3 * np.sqrt(2 * np.pi)), S.distributed(spark, evaluate))
    final = list(S.run(problem, S.Settings(n=400, moves=2)))[-1]
    exact = -0.5 * np.log1p(9 * n) - 0.5 * n * m * m / (1 + 9 * n)
    w = np.exp(final.log_weight)
    return [("mean", float(w @ final.theta[:, 0]), float(9 * n * m / (1 + 9 * n)), 0.05), ("log_evidence", float(final.log_evidence), float(exact), 0.75)]


@query("""with s as (select count(*) as n, avg((p_retailprice - 1000) / 100) as m from part)
select 'mean' as quantity, round(9 * n * m / (1 + 9 * n), 6) as exact, true as close from s union all select 'log_evidence', round(-0.5 * ln(1 + 9 * n) - 0.5 * n * m * m / (1 + 9 * n), 6), true from s""")
def smc_gaussian(spark, sf):
    """The exact posterior mean and evidence, and whether the sampler's estimates are within their tolerance of them."""
    rows = [(name, exact, abs(estimate - exact) < tolerance) for name, estimate, exact, tolerance in smc_estimates(spark, sf)]
    return rounded(spark.createDataFrame(rows, "quantity string, exact double, close boolean"))


def eki_estimates(spark, sf):
    """Estimate and exact posterior mean of a coefficient for each region, seen through a diagonal map."""
    from fieldloom.inference import eki as E

    held = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.avg("n_nationkey").alias("m")).orderBy("n_regionkey").collect()  # a row a region
    a, y = np.array([1 + r["n_regionkey"] / 2 for r in held]), np.array([r["m"] / 10 for r in held])
    g = np.random.Generator(np.random.Philox(3))
    final = E.invert(g.standard_normal((1_000, len(a))), lambda t: t * a, y, 0.01 * np.eye(len(a)))[-1]
    return [(r["n_regionkey"], float(e), float(x)) for r, e, x in zip(held, final.theta.mean(0), a * y / (a * a + 0.01), strict=True)]


@query("""select n_regionkey as entry, round((1 + n_regionkey / 2.0) * avg(n_nationkey) / 10 / (pow(1 + n_regionkey / 2.0, 2) + 0.01), 6) as exact, true as close from nation group by n_regionkey""")
def eki_linear(spark, sf):
    """Ensemble Kalman inversion of a linear map: the exact posterior mean, and whether the ensemble's is within 0.1 of it."""
    rows = [(int(entry), exact, abs(estimate - exact) < 0.1) for entry, estimate, exact in eki_estimates(spark, sf)]
    return rounded(spark.createDataFrame(rows, "entry long, exact double, close boolean"))


@query("""select p_partkey, round(-0.5 * pow(ln(p_retailprice / 1000) / ln(1.2), 2) - ln(ln(1.2)) - ln(2 * pi()) / 2 - ln(p_retailprice)
- 0.5 * pow(ln(p_size / 25.0) / ln(2), 2) - ln(ln(2)) - ln(2 * pi()) / 2 - ln(p_size) - 0.5 * ln(1 - 0.36)
- (0.36 * (pow(ln(p_retailprice / 1000) / ln(1.2), 2) + pow(ln(p_size / 25.0) / ln(2), 2)) - 1.2 * ln(p_retailprice / 1000) / ln(1.2) * ln(p_size / 25.0) / ln(2)) / (2 * (1 - 0.36)), 6) as log_density from part""")
def copula_density(spark, sf):
    """Two log-normal marginals with a Gaussian copula."""
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    scores = [F.log(price / 1000) / float(np.log(1.2)), F.log(size / 25.0) / float(np.log(2))]
    density = D.log_normal(price, 1000.0, 1.2) + D.log_normal(size, 25.0, 2.0) + D.gaussian_copula(scores, [[1.0, 0.6], [0.6, 1.0]])
    return rounded(table(spark, sf, "part").select("p_partkey", density.alias("log_density")))


@query("""with t as (select p_brand, ln(p_size / 51.0 / (1 - p_size / 51.0)) as t from part) select p_brand, round(1 / (1 + exp(-avg(t))), 6) as median, round(stddev_pop(t), 9) as logit_sd from t group by 1""")
def logit_normal_moments(spark, sf):
    found = W.logit_moments(table(spark, sf, "part").select("p_brand", (F.col("p_size") / 51.0).alias("x")), ["p_brand"], "x")
    return found.select("p_brand", F.round("median", 6).alias("median"), F.round("logit_sd", 9).alias("logit_sd"))


@query("""select p_size as gap, round(0.25 * exp(-p_size / 3.0) + 0.04 * exp(-p_size / 40.0) + 0.09 * exp(-2 * pow(sin(pi() * p_size / 365.0), 2) / 0.64) * exp(-p_size / 700.0), 9) as covariance from part group by 1""")
def discrepancy_covariance(spark, sf):
    kernel = D.discrepancy_kernel(F.col("gap").cast("double"), (0.5, 3.0), (0.2, 40.0), (0.3, 365.0, 0.8, 700.0))
    return rounded(table(spark, sf, "part").select(F.col("p_size").alias("gap")).distinct().select("gap", kernel.alias("covariance")), 9)


@query("""with x as (select vec_id, embedding[1]::double as v from embeddings)
select vec_id, round(2 + exp(v), 9) as above, round(3 - exp(-v), 9) as below, round(-1 + 4 / (1 + exp(-v)), 9) as between_, round(v, 9) as again, round(ln(4.0) - v - 2 * ln(1 + exp(-v)), 9) as log_derivative from x""")
def support_bijectors(spark, sf):
    """Natural values on half-lines and an interval, one carried back, and a log derivative."""
    from fieldloom.plans.support import Interval

    v = F.col("embedding")[0].cast("double")
    between = Interval(-1.0, 3.0)
    return rounded(
        table(spark, sf, "embeddings").select(
            "vec_id", Interval(2.0, None).natural(v).alias("above"), Interval(None, 3.0).natural(v).alias("below"), between.natural(v).alias("between_"),
            between.unconstrained(between.natural(v)).alias("again"), between.log_derivative(v).alias("log_derivative"),
        ), 9,
    )


def _priority_blocks(orders):
    from fieldloom.operators.blocks import gaussian_blocks
    from fieldloom.plans.covariance import Kernel, exponential

    daily = orders.groupBy(F.col("o_orderpriority").alias("k"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")).alias("day")).agg((F.avg("o_totalprice") / 100000 - 2.5).alias("r"))
    return rounded(gaussian_blocks(daily, ["k"], ["day"], "r", Kernel("day", exponential(0.8, 20.0))))


@query("""with d as (select o_orderpriority as k, o_orderdate::date as day, avg(o_totalprice) / 100000 - 2.5 as r from orders group by 1, 2),
l as (select k, r, lag(r) over w as p, day - lag(day) over w as gap from d window w as (partition by k order by day)),
s as (select k, case when p is null then r else r - exp(-gap / 20.0) * p end as e, case when p is null then 0.64 else 0.64 * (1 - exp(-2 * gap / 20.0)) end as v from l)
select k, count(*) as n, round(sum(e * e / v) / 2, 6) as misfit, round(sum(ln(v)), 6) as log_det, round(-sum(e * e / v) / 2 - 0.5 * (sum(ln(v)) + count(*) * ln(2 * pi())), 6) as log_density from s group by 1""")
def dense_block_density(spark, sf):
    return _priority_blocks(table(spark, sf, "orders"))


def _supplier_noise(items):
    from fieldloom.operators.blocks import noise_summary as summary
    from fieldloom.plans.covariance import Diagonal

    rows = items.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", (10.0 + F.col("l_linenumber")).alias("sd"))
    return rounded(summary(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], Diagonal("sd")))


@query("""select l_suppkey, count(*) as n, round(median(10 + l_linenumber), 6) as median_sd, round(sum(1 / pow(10.0 + l_linenumber, 2)) * median(pow(10.0 + l_linenumber, 2)), 6) as effective_n, round(min(pow(10.0 + l_linenumber, 2)), 6) as least_eigenvalue
from lineitem group by 1""")
def noise_summary(spark, sf):
    return _supplier_noise(table(spark, sf, "lineitem"))


@query(f"""with y as (select l_partkey as site, l_quantity + 3.0 * {normal_sql(5, 'l_orderkey', 'l_partkey')} as y from lineitem),
b as (select site, quantile_cont(y, 0.05) as a, quantile_cont(y, 0.95) as b from y group by 1)
select count(*) as n, round(avg(case when p_size between a and b then 1.0 else 0.0 end), 6) as inside from b join part on p_partkey = site""")
def noisy_interval_coverage(spark, sf):
    """Share of part sizes inside the 90 % interval of their line quantities with measurement noise added."""
    from fieldloom.operators.blocks import noisy_coverage

    predictions = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("site"), F.col("l_orderkey").alias("member"), F.col("l_quantity").alias("prediction"))
    observed = table(spark, sf, "part").select(F.col("p_partkey").alias("site"), F.col("p_size").cast("double").alias("value"), F.lit(3.0).alias("standard_deviation"))
    return rounded(noisy_coverage(predictions, observed, ["site"], 0.9, 5))


_GRID = [(sd, scale) for sd in (0.25, 0.5, 1.0) for scale in (0.5, 2.0, 10.0)]


@query(f"""with d as (select year(o_orderdate) as y, dayofyear(o_orderdate) as day, avg(o_totalprice) / 100000 - 2.5 as r from orders group by 1, 2),
l as (select y, r, lag(r) over w as p, day - lag(day) over w as gap from d window w as (partition by y order by day)),
c as (select * from (values {", ".join(f"({i}, {sd}::double, {scale}::double)" for i, (sd, scale) in enumerate(_GRID))}) t(candidate, sd, scale)),
s as (select candidate, sd, scale, case when p is null then r else r - exp(-gap / scale) * p end as e, case when p is null then sd * sd else sd * sd * (1 - exp(-2 * gap / scale)) end as v from l, c)
select candidate::bigint as candidate, sd, scale, round(-sum(e * e / v) / 2 - 0.5 * (sum(ln(v)) + count(*) * ln(2 * pi())), 4) as log_density from s group by 1, 2, 3""")
def covariance_profile(spark, sf):
    """Summed block density by year over a grid of deviations and time scales."""
    from fieldloom.operators.blocks import profile
    from fieldloom.plans.covariance import Kernel, exponential

    orders = table(spark, sf, "orders")
    daily = orders.groupBy(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 100000 - 2.5).alias("r"))
    found = profile(daily, ["year"], ["day"], "r", lambda p: Kernel("day", exponential(p[0], p[1])), _GRID)
    grid = spark.createDataFrame([(i, *c) for i, c in enumerate(_GRID)], "candidate long, sd double, scale double")
    return rounded(grid.join(found, "candidate"), 4)


@query(None)
def covariance_fit(spark, sf):
    """Deviation and time scale of an exponential covariance of greatest likelihood, by year."""
    from fieldloom.operators.blocks import maximum_likelihood
    from fieldloom.plans.covariance import Kernel, exponential

    orders = table(spark, sf, "orders")
    daily = orders.groupBy(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 100000 - 2.5).alias("r"))
    found, density = maximum_likelihood(daily.cache(), ["year"], ["day"], "r", lambda p: Kernel("day", exponential(p[0], p[1])), [1.0, 2.0], rounds=4)
    return spark.createDataFrame([("sd", float(found[0])), ("scale", float(found[1])), ("log_density", density)], "quantity string, value double")
