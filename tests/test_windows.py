import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldloom.functions import aggregates as G
from fieldloom.functions import time as T
from fieldloom.operators import windows as W

D = dt.datetime


def steps(spark, rows):
    return spark.createDataFrame(rows, "site int, time timestamp_ntz, value double")


def test_cells_are_right_closed_with_end_labels(spark):
    rows = [(1, D(2020, 1, 1), 1.0), (1, D(2020, 1, 1, 0, 0, 0, 1), 2.0), (1, D(2020, 1, 2), 4.0), (1, D(1969, 12, 31, 12), 8.0)]
    found = {r["cell"]: r["sum"] for r in W.aggregate_cells(steps(spark, rows), ["site"], "1D", kind="total").collect()}
    assert found == {D(2020, 1, 1): 1.0, D(2020, 1, 2): 6.0, D(1970, 1, 1): 8.0}


def test_month_and_year_edges(spark):
    rows = [(1, D(2020, 2, 1), 1.0), (1, D(2020, 2, 1, 1), 2.0), (1, D(2021, 1, 1), 3.0)]
    frame = steps(spark, rows)
    assert {r["cell"]: r["last"] for r in W.aggregate_cells(frame, ["site"], "MS", kind="end_state").collect()} == {D(2020, 2, 1): 1.0, D(2020, 3, 1): 2.0, D(2021, 1, 1): 3.0}
    assert {r["cell"]: r["mean"] for r in W.aggregate_cells(frame, ["site"], "YS", kind="mean").collect()} == {D(2021, 1, 1): 2.0}


def test_a_gap_makes_every_reduction_missing(spark):
    rows = [(1, D(2020, 1, 1, h), None if h == 3 else float("nan") if h == 4 else float(h)) for h in range(1, 6)]
    for how in ("sum", "mean", "min", "max", "first", "last"):
        r = W.aggregate_cells(steps(spark, rows), ["site"], "1D", how=how).first()
        assert r[how] is None and (r["n_steps"], r["n_present"]) == (5, 3)


def test_windows_spans_and_empty_ones(spark):
    field = steps(spark, [(1, D(2020, 1, 1, 6) + dt.timedelta(hours=6 * i), float(i)) for i in range(20)])
    windows = spark.createDataFrame([(0, D(2020, 1, 1, 6), D(2020, 1, 4, 6)), (1, D(2021, 1, 1), D(2021, 1, 2)), (2, D(2020, 1, 4, 6), D(2020, 1, 4, 6, 1))], "w int, window_start timestamp_ntz, window_end timestamp_ntz")
    found = {r["w"]: (r["sum"], r["n_steps"], r["first"]) for r in W.reduce_windows(field.drop("site"), windows, ["sum", "first"], ["w", "window_start", "window_end"]).collect()}
    assert found == {0: (78.0, 12, 1.0), 1: (None, 0, None), 2: (None, 0, None)}
    plan = W.reduce_windows(field.drop("site"), windows, ["sum"], ["w", "window_start", "window_end"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_as_of_reads_the_step_that_holds_the_label(spark):
    field = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 3), 5.0), (1, D(2020, 1, 3), D(2020, 1, 4), 6.0)], "site int, timestep_start timestamp_ntz, timestep_end timestamp_ntz, v double")
    labels = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 1, 1)), (1, D(2020, 1, 3)), (1, D(2020, 1, 4)), (2, D(2020, 1, 2))], "site int, time timestamp_ntz")
    found = [(r["site"], r["time"].day, r["v"]) for r in W.as_of(labels, field, ["site"]).orderBy("site", "time").collect()]
    assert found == [(1, 1, None), (1, 1, 5.0), (1, 3, 5.0), (1, 4, 6.0), (2, 2, None)]


def test_padding_clock_and_guard(spark):
    padded = spark.createDataFrame([(None, None), (D(2020, 1, 1), 1.0)], "timestep_start timestamp_ntz, value double")
    assert W.without_padding(padded).count() == 1
    with pytest.raises(PySparkException, match="padding"):
        W.without_padding(spark.createDataFrame([(None, 1.0)], "timestep_start timestamp_ntz, value double")).collect()
    local = spark.createDataFrame([(1, D(2020, 1, 1))], "site int, time timestamp_ntz")
    half = spark.createDataFrame([(1, -5.5)], "site int, utc_offset_hours double")
    assert W.to_utc(local, half, ["site"], T.HOUR // 2).first()["time"] == D(2020, 1, 1, 5, 30)
    with pytest.raises(PySparkException, match="whole number"):
        W.to_utc(local, half, ["site"], T.HOUR).collect()
    record = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 2, 1))], "site int, record_start timestamp_ntz, record_end timestamp_ntz")
    windows = spark.createDataFrame([(1, D(2020, 1, 1), D(2020, 1, 5)), (1, D(2020, 1, 30), D(2020, 2, 2)), (2, D(2020, 1, 1), D(2020, 1, 2))], "site int, window_start timestamp_ntz, window_end timestamp_ntz")
    assert W.inside_record(windows, record, ["site"]).count() == 1
    assert W.outside_record(windows, record, ["site"]).count() == 2 and W.outside_record(windows, record, ["site"], T.DAY).count() == 1


def test_kinds_choose_reductions():
    assert [G.reduction_for(k, None) for k in ("total", "mean", "daily_rate", "end_state", "cumulative")] == ["sum", "mean", "mean", "last", "last"]
    for kind, how in (("start_coordinate", None), ("total", "max"), ("mean", "sum"), ("cumulative", "min")):
        with pytest.raises(ValueError):
            G.reduction_for(kind, how)
    with pytest.raises(ValueError):
        W.cell_label(F.col("time"), "fortnight")


def test_week_rules_differ(spark):
    days = spark.sql("select explode(sequence(date'2015-12-25', date'2016-12-31')) as d").select("d", T.week_of_year(F.col("d")).alias("a"), T.iso_week(F.col("d")).alias("b"), T.season(F.col("d")).alias("s"))
    held = {str(r["d"]): (r["a"], r["b"], r["s"]) for r in days.collect()}
    assert held["2016-01-01"] == (1, 52, 0) and held["2016-12-31"] == (52, 52, 0) and held["2016-03-01"][2] == 1 and held["2016-01-08"] == (2, 1, 0)


def test_weighted_mean_of_no_weight_is_missing(spark):
    frame = spark.createDataFrame([(1, 2.0, 0.0), (1, 3.0, 0.0), (2, 1.0, 1.0), (2, 4.0, 3.0)], "k int, v double, w double")
    found = dict(tuple(r) for r in frame.groupBy("k").agg(G.reduction("mean", F.col("v"), F.col("v"), F.col("w")).alias("m")).collect())
    assert found == {1: None, 2: 3.25}
