import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.operators import checks as C
from fieldloom.operators import joins as J
from fieldloom.operators import reshape as R
from fieldloom.operators import rules as P
from fieldloom.operators import select as S


def test_lookup_refuses_unknown_keys(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert J.lookup(spark.createDataFrame([(2,), (1,), (2,)], "k int"), table, ["k"]).count() == 3
    with pytest.raises(PySparkException, match="no row for key 3"):
        J.lookup(spark.createDataFrame([(3,)], "k int"), table, ["k"]).collect()


def test_one_to_one_refuses_repeats(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 2)], "k int, x int"), spark.createDataFrame([(1, 5)], "k int, y int")
    assert sorted(tuple(r) for r in J.one_to_one(a, b, ["k"]).collect()) == [(1, 1, 5), (2, 2, None)]
    with pytest.raises(PySparkException, match="repeats on the right"):
        J.one_to_one(a, b.union(b), ["k"]).collect()


def test_zip_or_cross(spark):
    a, b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "sample int, x double"), spark.createDataFrame([(1, 5.0), (0, 4.0)], "sample int, y double")
    assert sorted(r["x"] * r["y"] for r in J.zip_or_cross(a, b, ["sample"]).collect()) == [4.0, 10.0]
    assert J.zip_or_cross(a, b.withColumnRenamed("sample", "site"), ["sample", "site"]).count() == 4
    with pytest.raises(PySparkException, match="labels of sample differ"):
        J.zip_or_cross(a, b.where("sample = 0"), ["sample"]).collect()


def test_request_order_and_selection(spark):
    sites = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "site_id int, lon double, lat double")
    found = S.select_sites(sites, ids=[5, 2, 5, 7], box=(0, 0, 6, 1), where=F.col("lon") > 1).orderBy("position").collect()
    assert [(r["position"], r["site_id"]) for r in found] == [(0, 5), (1, 2), (2, 5)]
    with pytest.raises(PySparkException):
        S.select_sites(sites, ids=[99]).collect()
    with pytest.raises(PySparkException, match="missing"):
        S.select_sites(sites, where=F.lit(None).cast("boolean")).collect()


def test_static_and_dense_refuse_bad_copies(spark):
    ok = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (2, None)], "k int, v double")
    assert sorted((r["k"], r["v"]) for r in R.static_values(ok, ["k"], ["v"]).collect()) == [(1, 2.0), (2, None)]
    with pytest.raises(PySparkException, match="differ"):
        R.static_values(ok.union(spark.createDataFrame([(2, 1.0)], "k int, v double")), ["k"], ["v"]).collect()
    axis = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert R.dense(spark.createDataFrame([(1, 2.0)], "k int, v double"), [axis], ["v"]).count() == 3
    with pytest.raises(PySparkException, match="repeats"):
        R.dense(ok, [axis], ["v"]).collect()


def test_numbering_is_global(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(9)
    assert sorted((r["x"], r["n"]) for r in R.numbered(frame, ["x"], "n").collect()) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_and_resampling_keep_payload_rows(spark, adaptive):
    """Over a million rows with wide columns, whatever the engine does with the ranges of a second exchange."""
    from fieldloom.operators.weights import systematic_resample

    n = 1_200_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        frame = spark.range(n).select((F.col("id") * 7919 % n).alias("x"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("payload"), (1.0 + F.col("id") % 3).alias("w"))
        found = R.numbered(frame, ["x"], "n").agg(F.count("*"), F.countDistinct("n"), F.count_if(F.col("n") != F.col("x")), F.count("payload")).first()
        assert tuple(found) == (n, n, 0, n)
        drawn = systematic_resample(frame, "x", "w", 1_000_000, 0.4)
        found = drawn.agg(F.count("*"), F.countDistinct("draw"), F.max("draw"), F.count_if(F.length("payload") != 128)).first()
        assert tuple(found) == (1_000_000, 1_000_000, 999_999, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_thinning(spark):
    import numpy as np

    frame = spark.range(103).withColumnRenamed("id", "p")
    for n in (1, 2, 7, 50, 103, 200):
        want = set(range(103)) if n >= 103 else {int(x) for x in np.rint(np.linspace(0, 102, n))}
        assert {r["p"] for r in R.thin(frame, "p", 103, n).collect()} == want


def test_replacing_values_needs_equal_keys(spark):
    held = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert R.replace_values(held, held.withColumn("v", F.lit(9.0)), ["k"], "v").first()["v"] == 9.0
    with pytest.raises(PySparkException, match="keys of the new values differ"):
        R.replace_values(held, held.withColumn("k", F.lit(4)), ["k"], "v").collect()


def test_require_tells_the_rows(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    C.require("unique k", C.repeated_keys(frame.distinct(), ["k"]))
    with pytest.raises(C.ContractViolation, match="unique k: 1 violating rows"):
        C.require("unique k", C.repeated_keys(frame, ["k"]), "Drop the copies.")


def test_rules(spark):
    rules = [P.copy("a", "x"), P.compute("b", lambda a, y: a * y), P.fixed("c", 3), *P.simplex(["f", "g"], "s")]
    frame = spark.createDataFrame([(1, 2.0, 5.0, [0.2, 0.3, 0.5])], "k int, x double, y double, s array<double>")
    assert tuple(P.apply(frame, rules, ["k"]).first()) == (1, 2.0, 10.0, 3.0, 0.2, 0.3)
    assert P.dependencies(rules)["b"] == {"x", "y"}
    with pytest.raises(P.RuleError, match="two rules"):
        P.apply(frame, [P.copy("a", "x"), P.copy("a", "y")], ["k"])
    with pytest.raises(P.RuleError, match="nothing gives"):
        P.apply(frame, [P.copy("a", "lost")], ["k"])
    with pytest.raises(PySparkException, match="no value for"):
        P.apply(frame, [P.fixed_by("d", "k", {"7": 1.0})], ["k"]).collect()
    good = {"soil_organic_carbon": 1.0, "wood_carbon": 1.0, "leaf_carbon": 1.0, "soil_moisture": 50.0, "f": 0.2, "g": 0.2, "a": 270.0, "d": False}
    bad = [{"soil_organic_carbon": -1.0}, {"soil_moisture": 101.0}, {"f": 0.6, "g": 0.395}, {"soil_moisture": None}, {"f": -0.1}, {"a": 1e-7}, {"leaf_carbon": None}, {"leaf_carbon": -1.0}, {"wood_carbon": float("nan")}, {"wood_carbon": float("inf")}]
    fine = [{}, {"leaf_carbon": None, "d": True}, {"leaf_carbon": -1.0, "d": True}, {"soil_moisture": 0.0}]
    kinds = ", ".join(f"{k} {'boolean' if k == 'd' else 'double'}" for k in good)
    states = spark.createDataFrame([(i, *{**good, **x}.values()) for i, x in enumerate([*bad, *fine])], f"k int, {kinds}")
    assert [r["k"] for r in P.refused_states(states, ["k"], "a", "f", "g", "d").orderBy("k").collect()] == list(range(len(bad)))
    pools = ["k", "soil_organic_carbon", "wood_carbon", "leaf_carbon", "soil_moisture", "d"]
    kept = states.where(f"k >= {len(bad)}")
    made = P.member_states(kept.select(*pools), kept.select("k", "a", "f", "g"), ["k"], "a", "f", "g", "d")
    assert [r["lai_init"] for r in made.orderBy("k").collect()] == [1000 / 270, 0.0, 0.0, 1000 / 270] and len(made.columns) == 7
    with pytest.raises(PySparkException, match="no initial state: it has no parameters"):
        P.member_states(kept.select(*pools), kept.where("k <> 11").select("k", "a", "f", "g"), ["k"], "a", "f", "g", "d").collect()
    with pytest.raises(PySparkException, match="soil_moisture is no percentage"):
        P.member_states(states.where("k = 1").select(*pools), states.where("k = 1").select("k", "a", "f", "g"), ["k"], "a", "f", "g", "d").collect()
    with pytest.raises(P.RuleError, match="dims that the states lack"):
        P.member_states(kept.select(*pools), kept.select("k", "a", "f", "g", F.lit(1).alias("pft")), ["k"], "a", "f", "g", "d")


def test_observation_spans():
    assert S.period("2012") == ("2012-01-01 00:00:00", "2013-01-01 00:00:00") and S.period("2012-02") == ("2012-02-01 00:00:00", "2012-03-01 00:00:00")
    assert S.period("2012-02-29")[1] == "2012-03-01 00:00:00"
