from __future__ import annotations

import re

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")

#: Texts that every text operator must take.
ODD = [None, "", " ", "\n\n", "a", "A a", "  two   words ", "x" * 5000, "é漢😀 ß", "tab\there\x00zero", "‏rtl", "don't <|endoftext|> stop", "a b c " * 3000]


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def solid(text):
    return SOLID.findall((text or "").translate(LOWER))


def documents(spark, texts, **columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def wide(frame):
    """The same rows with null ids among them and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    extra = {c: F.lit("extra") for c in ("n_words", "key", "grams", "row", "part", "shard", "label", "place", "weight", "kept", "sig", "bucket", "digest", "window", "_c0")}
    return frame.withColumns(extra)
