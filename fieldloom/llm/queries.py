"""The text operators as queries over whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import chat_links, dac, html_extract, jaccard_join, language_id, license_rules, media, mixing, token_counts, winnowing
from fieldloom.llm.shared import bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_links.link_conversations(_table(spark, sf_dir, "conversations"))


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_file_digest(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixture(docs).select("doc_id", "source", "lang", "topic", "n_words", "weight", "p_keep", "kept", "fit_gap")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_tool_call_linking,
        op3_token_id_files,
        op4_token_counts,
        op5_license_scan,
        op6_ngram_jaccard_join,
        op7_source_mixing,
        op8_language_id,
        op9_media_columns,
        op10_decontamination,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(separators: str) -> str:
    return f"list_filter(string_split_regex({_LOWERED}, '{separators}'), lambda x: x <> '')"


#: The contracts that SQL can express in full; the other operators are tested against brute force.
ORACLE: dict[str, str] = {
    "op6_ngram_jaccard_join": rf"""with recursive w as (select doc_id, {_words(r"[\x20\x09-\x0D]+")} as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
g as (select doc_id, len(s) as n, unnest(s) as g from s),
o as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as o from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from o where 100 * o >= 90 * (m + n - o)),
c as (select doc_id, doc_id as r from documents union select c.doc_id, e.y from c join e on e.x = c.r)
select s.doc_id, len(s.s) as n_shingles, (select min(r) from c where c.doc_id = s.doc_id) as component_id from s""",
    "op10_decontamination": rf"""with d as (select doc_id, {_words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from documents),
b as (select item_id::varchar as item, {_words(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from benchmark),
v as (select distinct item, least(10, len(w)) as n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') as g from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0)),
k as (select distinct n from v),
t as (select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, k where len(w) >= n)),
h as (select doc_id, item, p, t.n as n from t join v on v.n = t.n and v.g = t.g),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by 1),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from h) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join c using (doc_id) left join i using (doc_id)""",
}
