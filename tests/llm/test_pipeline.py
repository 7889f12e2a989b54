import time

import corpus_pipeline as P
from pyspark.sql import functions as F

from fieldloom.llm.language_id import language_id
from fieldloom.llm.shared import Workspace, local_table
from fieldloom.staging import CLEANUP

from .helpers import ODD, documents
from .test_jaccard import brute as components
from .test_winnowing import brute as contamination


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = documents(spark, ODD).selectExpr("doc_id + 900000 as doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as long) as n_chars")
    docs = docs.union(extra).cache()
    columns = docs.columns

    first = P.language(spark, docs, sf).cache()
    und = {r["doc_id"] for r in language_id(docs).where("lang_pred = 'und'").collect()}
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in docs.collect()} - und
    assert first.where("lang is null").count() == 0 and und

    second = P.near_duplicates(spark, first, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert second.columns == columns and {r["doc_id"] for r in second.collect()} == {d for d, (_, c) in components(rows, 5, 4, 5).items() if d == c}

    third = P.decontaminate(spark, second, sf).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = contamination([(r["doc_id"], r["text"]) for r in second.collect()], items)
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == {d for d, x in found.items() if not x[-1]}

    fourth = P.mixture(spark, third, sf).cache()
    assert fourth.columns == columns and 0 < fourth.count() < third.count() and fourth.exceptAll(third).count() == 0

    last = P.token_ids(spark, fourth, sf)
    assert last.count() == fourth.count() and last.agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first()[0] == last.agg(F.sum("n_tokens")).first()[0]


def test_run_is_its_stages(spark, sf):
    assert P.run(spark, sf).count() > 0
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "mixture", "token_ids"]


def test_null_and_repeated_ids(spark, sf):
    """Each row is judged by its own text, whatever its id."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    text = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' and n_chars between 400 and 3000").orderBy("doc_id").first()["text"]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").orderBy("item_id").first()["text"]
    other = "an entirely different text of some words that stands alone under an id that repeats"
    twice = "yet another one that is repeated with its own id and holds words which nothing else here shares"
    rows = [(1, text), (5, text + " end"), (5, other), (None, text), (None, other + " but here"), (None, item), (7, item), (7, "12 34 !!"), (None, "12 34"), (8, twice), (8, twice)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), f"x{i}") for i, (d, t) in enumerate(rows)], columns)

    learned = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("x")).select(*docs.columns).union(docs)
    first = P.language(spark, learned, sf).where("extra <> 'x'")
    assert sorted(r["extra"] for r in first.collect()) == sorted(f"x{i}" for i in range(len(rows)) if i not in (7, 8))

    second = P.near_duplicates(spark, docs, sf)
    found = sorted(r["extra"] for r in second.collect())
    assert second.columns == docs.columns
    # of near copies the least id, of rows without one the last; of two equal rows either
    assert [x for x in found if x not in ("x9", "x10")] == ["x0", "x2", "x6", "x7", "x8"] and len(found) == 6

    third = P.decontaminate(spark, docs, sf)
    assert sorted(r["extra"] for r in third.collect()) == sorted(f"x{i}" for i in range(len(rows)) if i not in (5, 6))

    assert P.mixture(spark, docs, sf).exceptAll(docs).count() == 0
    assert P.token_ids(spark, docs, sf).count() == len(rows)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0


def test_no_pool_of_python_workers_beside_the_one_for_batches(spark, sf, monkeypatch):
    """RDDs of Python objects would start other workers on the executors, which stay beside those of the stages."""

    def refused(*_, **__):
        raise AssertionError("an RDD of Python objects")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf).limit(1).count() == 1, name


def test_local_table(spark):
    rows = [("a", 1.5, 2**60), (None, None, None)]
    assert [tuple(r) for r in local_table(spark, rows, "x string, y double, z long").collect()] == rows
    assert local_table(spark, [], "x string, y double").dtypes == [("x", "string"), ("y", "double")]


def test_kept_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {x.rpartition("/")[2] for x in found if "shuffle_" in x}

    work, before = Workspace(spark, "shuffles"), files()
    kept = work.keep(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    until = time.time() + 10  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and kept.agg(F.sum("count")).first()[0] == 10_000 and spark.conf.get(CLEANUP, "false") == "false"
    work.drop()


def test_batches_of_the_stages_are_small(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        P.token_ids(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert int(spark.conf.get(name)) == P.BATCH_ROWS == 500
    finally:
        spark.conf.set(name, held)
