"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token counts are raked: their weights are scaled to
each marginal's target shares in turn until all three fit. A cell's documents are then kept with a probability in
proportion to its weight over its tokens, scaled to the wanted share of all tokens and calibrated so that cells whose
documents are all kept pass what is missing on to the others. A document is kept where a hash of its id and text is below
its probability, so the draw doesn't depend on partitions and repeats exactly.

The topic is the one whose terms a document holds most often (``TERMS``, fixed words), ``general`` where that is fewer
than two or under one word in ``TERM_SHARE``; of equal topics the first by name.

Counts are over all documents. A cell table of at most ``CELLS`` rows is raked in memory, a larger one by the same steps as
DataFrame aggregations. Sums may differ in their last bits between the two, so probabilities are rounded to
``1 / GRID`` before the draw, by which both keep the same documents. ``fit_gap`` reports the largest difference between a
target share and its raked share: above ``CLOSE`` where ``ROUNDS`` rounds didn't settle, as with targets that the cells
can't meet.

Defined results: a null source or language is the level ``unknown``; a null or empty text has no words and is never kept;
levels without a target share what the targets leave in proportion to their tokens (their own share where no target is
given); columns of the input named like the added ones are replaced; targets of absent levels are ignored and the rest
scaled to 1; an empty table gives an empty result; rows equal in id and text share one draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.shared import Workspace, local_table
from fieldloom.llm.text_kernel import ALNUM, NONSPACE, relieved, slices, utf8, word_hashes, word_spans

CELLS = 200_000
ROUNDS = 200
CLOSE = 1e-9
#: Bytes of text in a batch that goes back to the engine.
OUT_BYTES = 4_000_000
MARGINS = ("source", "lang", "topic")
#: Targets of the registered query: marginal shares by level; "*" gives every other level an equal part of its share.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"*": 1.0},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "*": 0.1},
    "topic": {"general": 0.9, "*": 0.1},
}
#: Share of all tokens that the mixture keeps.
KEEP = 0.5
SEED = 20240607
ADDED = ("topic", "n_words", "weight", "p_keep", "kept", "fit_gap")
GRID = 1 << 24
#: Words (fixed values, lower case) that speak for a topic; a word may be any run of letters and digits.
TERMS: dict[str, str] = {
    "commerce": "price prices order orders shipping cart discount offer sale customer customers payment invoice product products",
    "legal": "license licensed copyright warranty liability rights reserved agreement law permission terms court clause attorney gpl",
    "science": "study method methods results data analysis experiment theory model measure temperature cell energy species",
    "technical": "function class return import server http https www api key token password config error file code user login",
    "contact": "email mail phone tel fax street address contact call",
}
TERM_SHARE = 200
TOPICS = ("general", *sorted(TERMS))


@lru_cache(maxsize=1)
def _terms() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, ascending, and the topic of each."""
    held = [(w, k) for k, topic in enumerate(sorted(TERMS)) for w in TERMS[topic].split()]
    raw, offsets = utf8(pa.array([w for w, _ in held]))
    hashes = word_hashes(raw, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], np.array([k for _, k in held])[order]


def measured(docs: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``docs`` with ``__mix_words`` and ``__mix_topic`` of the text.

    Words are runs without ASCII white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(utf8(batch.column(0))[1], OUT_BYTES):  # small batches, as texts go back whole
                part = batch.slice(lo, hi - lo)
                words, topic = _measures(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], words, topic], [*part.schema.names[1:], "__mix_words", "__mix_topic"])

    held = docs.select(F.col("text").alias("__mix_text"), *kept)
    schema = T.StructType([*held.schema.fields[1:], T.StructField("__mix_words", T.LongType()), T.StructField("__mix_topic", T.StringType())])
    return held.mapInArrow(relieved(run), schema)


def _measures(text: pa.Array) -> tuple[pa.Array, pa.Array]:
    raw, offsets = utf8(text)
    hashes, topics = _terms()
    counts, kinds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_spans(part, at, ALNUM)
        words = word_hashes(part, starts, ends)
        place = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        hit = np.flatnonzero(hashes[place] == words)
        owner = np.searchsorted(first, hit, "right") - 1
        held = np.bincount(owner * len(TERMS) + topics[place[hit]], minlength=(hi - lo) * len(TERMS)).reshape(-1, len(TERMS))
        most = held.max(1)
        kinds.append(np.where((most >= 2) & (TERM_SHARE * most >= np.diff(first)), held.argmax(1) + 1, 0))
        counts.append(np.diff(word_spans(part, at, NONSPACE)[2]))
    topic = pa.DictionaryArray.from_arrays(pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(TOPICS)).cast(pa.string())
    return pa.array(np.concatenate(counts), pa.int64()), topic


def shares(tokens: pd.Series, target: Mapping[str, float]) -> pd.Series:
    """The target share of each level of a marginal, from its tokens; sums to 1."""
    out = pd.Series({k: float(target[k]) for k in tokens.index if k in target and k != "*"}, dtype=float)
    rest = tokens[[k for k in tokens.index if k not in out.index]]
    if len(rest):
        if "*" in target:
            left = pd.Series(target["*"] / len(rest), index=rest.index)
        else:
            left = rest / tokens.sum() if not len(out) else max(0.0, 1 - out.sum()) * rest / rest.sum()
        out = pd.concat([out, left])
    return out / out.sum()


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Weights of cells (columns of MARGINS and ``tokens`` > 0) that fit the marginal shares, summing to 1, and the gap left."""
    weight = cells["tokens"].to_numpy(float) / cells["tokens"].sum()
    steps = []
    for m in MARGINS:
        code, level = pd.factorize(cells[m])
        held = cells.groupby(m)["tokens"].sum().reindex(level)
        steps.append((code, shares(held, targets.get(m, {})).reindex(level).to_numpy()))
    for _ in range(rounds):
        off = 0.0
        for code, want in steps:
            have = np.bincount(code, weight, len(want))
            off = max(off, float(np.abs(have - want).max()))
            weight = weight * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
        if off < close:
            break
    weight = weight / weight.sum()
    return weight, max(float(np.abs(np.bincount(code, weight, len(want)) - want).max()) for code, want in steps)


def rake_distributed(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], work: Workspace, rounds: int = ROUNDS, close: float = CLOSE) -> tuple[DataFrame, float]:
    """``rake`` as aggregations over a cell table of any size; a step of all marginals is written, so lineage stays short."""
    total = cells.agg(F.sum("tokens").alias("total"))
    now = cells.crossJoin(F.broadcast(total)).select(*MARGINS, "tokens", (F.col("tokens") / F.col("total")).alias("weight"))
    wants = {}
    for m in MARGINS:
        target = targets.get(m, {})
        named = {k: v for k, v in target.items() if k != "*"}
        level = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("held")).withColumn("want", F.lit(None).cast("double"))
        for k, v in named.items():
            level = level.withColumn("want", F.when(F.col(m) == k, F.lit(float(v))).otherwise(F.col("want")))
        sums = level.agg(F.sum("want").alias("named"), F.sum(F.expr("if(want is null, held, 0)")).alias("open"), F.count_if(F.col("want").isNull()).alias("n"), F.sum("held").alias("all"))
        level = level.crossJoin(F.broadcast(sums))
        if "*" in target:
            other = F.lit(float(target["*"])) / F.col("n")
        else:
            other = F.when(F.col("named").isNull(), F.col("held") / F.col("all")).otherwise(F.greatest(F.lit(0.0), 1 - F.col("named")) * F.col("held") / F.col("open"))
        level = level.withColumn("want", F.coalesce("want", other)).select(m, "want")
        wants[m] = work.keep(level.crossJoin(F.broadcast(level.agg(F.sum("want").alias("s")))).select(m, (F.col("want") / F.col("s")).alias("want")), f"want-{m}")
    now = work.keep(now, "cells-0")
    for k in range(rounds):
        off = 0.0
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum("weight").alias("have")).join(wants[m], m)
            have = work.keep(have, f"have-{m}-{k}")
            off = max(off, have.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            factor = have.select(m, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("factor"))
            now = now.join(factor, m).select(*MARGINS, "tokens", (F.col("weight") * F.col("factor")).alias("weight"))
        now = work.keep(now, f"cells-{k + 1}")
        if off < close:
            break
    total = now.agg(F.sum("weight")).first()[0] or 1.0
    now = now.withColumn("weight", F.col("weight") / total)
    gaps = [now.groupBy(m).agg(F.sum("weight").alias("have")).join(wants[m], m).agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] for m in MARGINS]
    return now, max((g or 0.0) for g in gaps)


def probabilities(tokens: np.ndarray, weight: np.ndarray, keep: float) -> np.ndarray:
    """Keep probability of each cell: in proportion to weight over tokens, at most 1, keeping ``keep`` of all tokens."""
    wanted, p = keep * tokens.sum(), np.zeros(len(tokens))
    open_ = (tokens > 0) & (weight > 0)
    while open_.any():
        left = wanted - (tokens * p).sum()
        trial = np.where(open_, weight / np.maximum(tokens, 1) * (left / weight[open_].sum()), 0.0)
        full = open_ & (trial >= 1)
        if not full.any():
            return np.where(open_, trial, p)
        p[full] = 1.0
        open_ &= ~full
    return p


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, keep: float = KEEP, seed: int = SEED, cells_bound: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` with ``topic, n_words, weight, p_keep, kept, fit_gap``; all columns and rows stay.

    ``weight`` is the raked weight of the document's cell, ``p_keep`` its calibrated probability, ``kept`` the draw.
    """
    spark = docs.sparkSession
    level = {m: f"__mix_{m}" for m in MARGINS}
    levels = {level[m]: F.coalesce(m, F.lit("unknown")) for m in ("source", "lang")}
    counted = measured(docs, ["source", "lang"]).withColumns(levels)
    cells = counted.groupBy(*(F.col(level[m]).alias(m) for m in MARGINS)).agg(F.sum("__mix_words").alias("tokens")).where("tokens > 0")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit(""))), 11) / float(1 << 53)
    marked = measured(docs, docs.columns).withColumns({**levels, "__mix_draw": draw})
    work = Workspace(spark, "mixing")
    cells = work.keep(cells, "counts")
    if cells.limit(cells_bound + 1).count() <= cells_bound:
        table = cells.orderBy(*MARGINS).toPandas()
        table["weight"], gap = rake(table, targets, rounds) if len(table) else (np.zeros(0), 0.0)
        table["p_keep"] = probabilities(table["tokens"].to_numpy(float), table["weight"].to_numpy(float), keep) if len(table) else np.zeros(0)
        schema = "source string, lang string, topic string, weight double, p_keep double"
        plan = local_table(spark, table[[*MARGINS, "weight", "p_keep"]].values.tolist(), schema)
        plan = F.broadcast(plan)  # cells_bound rows at most
    else:
        raked, gap = rake_distributed(cells, targets, work, rounds)
        plan = _calibrated(raked, keep)
    plan = plan.withColumnsRenamed({m: f"__mix_cell_{m}" for m in MARGINS})
    on = [F.col(level[m]) == F.col(f"__mix_cell_{m}") for m in MARGINS]
    plan = plan.withColumnsRenamed({"weight": "__mix_weight", "p_keep": "__mix_p"})
    out = marked.join(plan, on, "left")
    p = F.rint(F.coalesce(F.col("__mix_p"), F.lit(0.0)) * GRID) / GRID
    return out.select(
        *(c for c in docs.columns if c.lower() not in ADDED),
        F.col(level["topic"]).alias("topic"),
        F.col("__mix_words").alias("n_words"),
        F.coalesce("__mix_weight", F.lit(0.0)).alias("weight"),
        p.alias("p_keep"),
        ((F.col("__mix_words") > 0) & (F.col("__mix_draw") < p)).alias("kept"),
        F.lit(gap).alias("fit_gap"),
    )


def _calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """``probabilities`` over a cell table of any size: one aggregation for each round of cells that are kept whole."""
    total = cells.agg(F.sum("tokens")).first()[0]
    full = -1.0  # ratio of weight to tokens from which a cell is kept whole
    ratio = F.col("weight") / F.col("tokens")
    scale, above = 0.0, float("inf")
    while full != above:
        full = above
        kept = F.when(ratio >= above, F.col("tokens")).otherwise(0)
        row = cells.agg(F.sum(kept), F.sum(F.when(ratio >= above, 0.0).otherwise(F.col("weight")))).first()
        if not row[1]:
            break
        scale = (keep * total - row[0]) / row[1]
        above = min(above, 1 / scale) if scale > 0 else above
    p = F.when(ratio >= above, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio * scale)))
    return cells.select(*MARGINS, "weight", p.alias("p_keep"))
