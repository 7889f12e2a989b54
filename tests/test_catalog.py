"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return connection


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame[sorted(frame.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        else:
            out[c] = out[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (float, np.floating)) else str(v))
    return out.sort_values(list(out.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, sf, name):
    got, want = comparable(catalog.QUERIES[name](spark, sf).toPandas()), comparable(duck.sql(catalog.ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_samplers_meet_the_exact_answers(spark, sf):
    from fieldloom.queries.inference import eki_estimates, smc_estimates

    rows = {name: (estimate, exact) for name, estimate, exact, _ in smc_estimates(spark, sf)}
    assert abs(rows["mean"][0] - rows["mean"][1]) < 0.05 and abs(rows["log_evidence"][0] - rows["log_evidence"][1]) < 0.3
    for _, estimate, exact in eki_estimates(spark, sf):
        assert abs(estimate - exact) < 0.1


def test_stream_equals_batch(spark, sf):
    a, b = (catalog.QUERIES[n](spark, sf) for n in ("cell_sum_daily", "cell_sum_streaming"))
    assert a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(b.columns))).count() == 0 and a.count() == b.count()


def test_random_sites_dont_depend_on_partitions(spark, sf):
    from fieldloom.operators.select import select_sites

    table = spark.read.parquet(f"{sf}/customer.parquet")
    a, b = ({r[0] for r in select_sites(t, "c_custkey", n_random=15, seed=3).collect()} for t in (table, table.repartition(7)))
    assert a == b and len(a) == 15
