"""A training-corpus pipeline: five stages, each on all that the one before kept.

1. language: drops documents in which no language is recognised, and fills in a missing ``lang``.
2. near_duplicates: word 5-gram sets with a Jaccard similarity of 0.8 or more; one document of each group stays.
3. decontaminate: drops documents that hold ten consecutive words of a benchmark item.
4. mixture: keeps documents with calibrated probabilities, so that tokens fit source, language and topic targets.
5. token_ids: writes the kept documents' token ids and reports each document from the files.

Every stage but the last returns the columns of documents. The language model learns from the labelled rows of the
documents table (never from those held out) and its prediction uses the text alone.

Decisions are taken for rows, not for ids: a row is known by a 64-bit hash of its doc_id and text, so rows with a null
doc_id, or different texts under one doc_id, each get their own decision, and rows equal in both share it. Of rows equal in
both, near_duplicates keeps one (its other columns are those of the row with the least hash); documents without words are
no duplicates and all stay there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import dac, jaccard_join, language_id, mixing, winnowing
from fieldloom.llm.shared import Workspace, bounded, without


#: The column that holds the row's hash within a stage.
ROW = "__row"
#: Rows of a batch for Python workers: the stages share executors, whose memory fills from stage to stage.
BATCH_ROWS = 500


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64("doc_id", "text"))


def _texts(docs: DataFrame) -> DataFrame:
    """The operators' view: the row's hash in place of its id."""
    return docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")


def _kept(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Distinct row hashes from ``doc_id``, as a table."""
    return Workspace(spark, name).keep(rows.select(F.col("doc_id").alias(ROW)).distinct(), "rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language."""
    bounded(spark, BATCH_ROWS)
    samples = language_id.training_samples(docs, ~language_id.held_out())
    found = Workspace(spark, "language").keep(language_id.identify(_texts(docs), samples), "found")
    # those that are rejected, and those without a label, are the few
    kept = without(_keyed(docs), _kept(spark, found.where(F.col("lang_pred") == language_id.UNKNOWN), "language"), ROW)
    if docs.where(F.col("lang").isNull()).limit(1).count():
        missing = _keyed(docs).where(F.col("lang").isNull()).select(ROW).distinct()
        named = found.withColumnRenamed("doc_id", ROW).join(missing, ROW, "left_semi").groupBy(ROW).agg(F.min("lang_pred").alias("__lang"))
        kept = kept.join(named, ROW, "left").withColumn("lang", F.coalesce("lang", "__lang"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; documents without words are no duplicates."""
    bounded(spark, BATCH_ROWS)
    losers, repeated = (x.withColumnRenamed("row", ROW) for x in jaccard_join.losers(docs, 5, 4, 5))
    work = Workspace(spark, "near-duplicates")
    kept = without(_keyed(docs), work.keep(losers, "losers"), ROW)
    repeated = work.keep(repeated, "repeated")
    if not repeated.limit(1).count():
        return kept.select(*docs.columns)
    # of rows that are equal in id and text the one with the least hash of its other columns
    order = F.xxhash64(*(F.col(c) for c in docs.columns))
    once = kept.join(repeated, ROW, "left_semi").groupBy(ROW).agg(F.min_by(F.struct(*docs.columns), order).alias("__one"))
    return without(kept, repeated, ROW).select(*docs.columns).union(once.select("__one.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark, BATCH_ROWS)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = winnowing.contamination(_texts(docs), items).where("contaminated")
    return without(_keyed(docs), _kept(spark, hit, "decontaminate"), ROW).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark, BATCH_ROWS)
    return mixing.mixture(docs).where("kept").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark, BATCH_ROWS)
    return dac.token_file_digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("token_ids", token_ids)]

#: Cross parsing, raking and tokenization aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again before the next."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
