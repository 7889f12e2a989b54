"""Queries over whole tables against their SQL, on tables that are larger than any subset by id or year."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldloom import catalog

from .test_catalog import TABLES, comparable

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def whole(spark, larger, name: str, rows: int | None = None) -> pd.DataFrame:
    """The query's rows, after they were found equal to its SQL's and as many as ``rows``, if given."""
    got, want = comparable(catalog.QUERIES[name](spark, SF).toPandas()), comparable(larger.sql(catalog.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=2e-6)
    assert rows is None or len(got) == rows
    return got


def test_noise_of_every_supplier(spark, larger):
    assert whole(spark, larger, "noise_summary", 100)["n"].astype(int).sum() == 60_000


def test_a_run_of_every_part_and_all_failures(spark, larger):
    runs = whole(spark, larger, "run_fanout_toy", 2_000)
    failed = whole(spark, larger, "failure_summary", 1)
    assert int(failed["runs"][0]) == (runs["status"] == "failed").sum() == 440


@pytest.mark.parametrize("name", ["weekly_year_means", "iso_week_year_means"])
def test_weeks_of_every_year(spark, larger, name):
    years = {int(y) for y in whole(spark, larger, name)["year"]}
    assert years == {y for (y,) in larger.sql("select distinct year(o_orderdate) from orders").fetchall()} and max(years) > 1998


def test_density_of_the_whole_record(spark, larger):
    days = larger.sql("select count(*) from (select distinct o_orderpriority, o_orderdate::date from orders)").fetchall()[0][0]
    assert whole(spark, larger, "dense_block_density", 5)["n"].astype(int).sum() == days


def test_covariance_is_fitted_on_every_year(spark, sf):
    found = {r["quantity"]: r["value"] for r in catalog.QUERIES["covariance_fit"](spark, sf).collect()}
    rows = duckdb.sql(f"select year(o_orderdate) as year, dayofyear(o_orderdate) as day, avg(o_totalprice) / 100000 - 2.5 as r from '{sf}/orders.parquet' group by 1, 2").df()
    want = 0.0
    for _, x in rows.groupby("year"):
        at, r = x["day"].to_numpy(float), x["r"].to_numpy(float)
        cov = found["sd"] ** 2 * np.exp(-np.abs(at[:, None] - at[None, :]) / found["scale"])
        want -= 0.5 * (r @ np.linalg.solve(cov, r) + np.linalg.slogdet(cov)[1] + len(x) * np.log(2 * np.pi))
    assert abs(found["log_density"] - want) < 1e-6 * abs(want)


def test_the_likelihood_counts_every_part(spark, sf):
    n, m = duckdb.sql(f"select count(*), avg((p_retailprice - 1000) / 100) from '{sf}/part.parquet'").fetchall()[0]
    exact = {r["quantity"]: r["exact"] for r in catalog.QUERIES["smc_gaussian"](spark, sf).collect()}
    assert n > 50 and np.isclose(exact["mean"], 9 * n * m / (1 + 9 * n))
    assert np.isclose(exact["log_evidence"], -0.5 * np.log1p(9 * n) - 0.5 * n * m * m / (1 + 9 * n))


def test_runs_of_every_supplier(spark, larger):
    whole(spark, larger, "run_enumeration", 3 * 5 * 100)


def test_layout_of_vectors_with_large_ids(spark, tmp_path):
    duckdb.sql(f"copy (select vec_id + 1990 as vec_id, * exclude (vec_id) from '{SF}/embeddings.parquet' where vec_id < 20) to '{tmp_path}/embeddings.parquet'")
    rows = catalog.QUERIES["layout_roundtrip"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = connection.sql(catalog.ORACLE["layout_roundtrip"]).fetchall()
    assert {(r["vec_id"], r["entry"], r["value"]) for r in rows} == set(want) and len(rows) == len(want) == 80
