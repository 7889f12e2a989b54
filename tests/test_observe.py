import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import analytics as A
from fieldloom.operators import ensemble as E
from fieldloom.operators import observe as O

D = dt.datetime


@pytest.fixture(scope="module")
def output(spark):
    rows = [(m, s, D(2012, 1, 1) + dt.timedelta(hours=6 * k), D(2012, 1, 1) + dt.timedelta(hours=6 * (k + 1)), float(m + s + k)) for m in range(3) for s in (1, 2) for k in range(20)]
    return spark.createDataFrame(rows, "member long, site int, timestep_start timestamp_ntz, time timestamp_ntz, carbon double")


@pytest.fixture(scope="module")
def observed(spark):
    rows = [(s, D(2012, 1, d), D(2012, 1, d - 1), D(2012, 1, d)) for s in (1, 2) for d in (2, 4)]
    return spark.createDataFrame(rows, "site int, time timestamp_ntz, window_start timestamp_ntz, window_end timestamp_ntz")


@pytest.mark.parametrize("operator", [O.SelectTimestep("carbon"), O.ReduceOverWindows("carbon", "sum"), O.AverageRate("carbon"), O.AbovegroundBiomass(0.5, "carbon")])
def test_operators_keep_their_contract(output, observed, operator):
    assert O.contract_violations(operator, output, observed, ["member"]).count() == 0
    assert operator.predict(output, observed, ["member"]).count() == 12


def test_contract_violations_are_found(spark, output, observed):
    class Broken:
        def predict(self, output, observed, batch):
            out = O.SelectTimestep("carbon").predict(output, observed, batch)
            return out.where("not (member = 0 and site = 1)").union(out.where("member = 1 and site = 1")).withColumn("prediction", F.when(F.col("site") == 2, F.lit(float("inf"))).otherwise(F.col("prediction")))

    found = {r["violation"]: r["n"] for r in O.contract_violations(Broken(), output, observed, ["member"]).collect()}
    assert found == {"repeated": 2, "missing": 2, "not finite": 6}


def test_rates_and_biomass(output, observed):
    rate = {(r["member"], r["site"], r["time"].day): r["prediction"] for r in O.AverageRate("carbon").predict(output, observed, ["member"]).collect()}
    assert rate[0, 1, 2] == pytest.approx(4 * np.mean([1, 2, 3, 4])) and rate[2, 2, 4] == pytest.approx(4 * np.mean([12, 13, 14, 15]))
    dry = {(r["member"], r["site"], r["time"].day): r["prediction"] for r in O.AbovegroundBiomass(0.5, "carbon").predict(output, observed, ["member"]).collect()}
    assert dry[0, 1, 2] == pytest.approx(2 * np.mean([1, 2, 3, 4]))
    for bad, kind in ((0.0, ValueError), (1.0, ValueError), (True, TypeError), ("x", TypeError)):
        with pytest.raises(kind):
            O.AbovegroundBiomass(bad)


def test_fan_out_ships_a_forcing_once_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 4)
    runs = spark.createDataFrame([(i, i % 3 if i % 10 else None, float(i)) for i in range(60)], "sample long, site long, a double").repartition(5)
    forcing = spark.createDataFrame([(s, t, float(s * 10 + t)) for s in (0, 1) for t in range(5)], "site long, t int, x double").repartition(3)

    def simulate(p, given):
        if p["a"] == 7:
            raise E.ModelFailure("seven")
        return pd.DataFrame({"first": [given["x"].iloc[0] if len(given) else -1.0], "total": [p["a"] + (given["x"].sum() if len(given) else 0.0)], "n": [len(given)]})

    found = {r["sample"]: r for r in E.fan_out(runs, simulate, forcing, ["sample", "site"], ["a"], "site", "t", "first double, total double, n long").collect()}
    assert len(found) == 60
    for i, r in found.items():
        site = i % 3 if i % 10 else None
        assert r["site"] == site
        if i == 7:
            assert (r["status"], r["error"], r["message"], r["total"]) == ("failed", "ModelFailure", "seven", None)
        elif site in (0, 1):
            assert (r["status"], r["n"], r["first"], r["total"]) == ("ok", 5, site * 10.0, i + 5 * site * 10 + 10.0)
        else:
            assert (r["n"], r["first"], r["total"]) == (0, -1.0, float(i))


def test_exponential_filter_by_a_loop(spark):
    g = np.random.default_rng(5)
    rows = [(k, t, float(x)) for k, n in ((1, 1), (2, 700), (3, 129)) for t, x in enumerate(g.standard_normal(n))]
    frame = spark.createDataFrame(rows, "k int, t int, x double").repartition(4)
    found = {(r["k"], r["t"]): r["filtered"] for r in A.exponential_filter(frame, ["k"], ["t"], "x", 7.0, 10).collect()}
    for k in (1, 2, 3):
        own = [x for j, _, x in rows if j == k]
        state = np.mean(own[:10])
        for t, x in enumerate(own):
            state += (x - state) / 7.0
            assert found[k, t] == pytest.approx(state, abs=1e-9)


def test_positions_of_observations(spark):
    rows = [(s, i % 17, D(2012, 1, 1) + dt.timedelta(days=i // 17), f"pad {i}") for s in ("b", "a") for i in range(340)]
    frame = spark.createDataFrame(rows, "source string, site int, time timestamp_ntz, note string").repartition(7)
    got = sorted((r["position"], r["source"], r["site"], r["time"]) for r in O.positions(frame).collect())
    assert [x[1:] for x in got] == sorted((s, i, t) for s, i, t, _ in rows) and [x[0] for x in got] == list(range(680))
