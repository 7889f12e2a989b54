import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import dac, token_counts
from fieldloom.llm.text_kernel import utf8
from fieldloom.llm.vocab import byte_alphabet, default_path, load

from .helpers import ODD, documents, wide

PATH = default_path(dac.TOKENIZER)
PIECES = st.lists(st.sampled_from(list("ab.,;!'’ \n\t09sté÷×ÿ<|>_ 　\x85\x1c漢😀") + ["<|endoftext|>", "don't", "  ", "\r\n", "aaaa", " a. b", "x\ny", "ABC", "the"]), max_size=40)


def library(text):
    return load(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=1, max_size=6))
def test_counts_and_ids_equal_the_library(texts):
    raw, offsets = utf8(pa.array(texts))
    want = [library(t) for t in texts]
    assert token_counts.count(raw, offsets, token_counts.counter(PATH)).tolist() == [len(x) for x in want]
    ids, lengths = dac.encode_texts(raw, offsets, dac.encoder(PATH))
    assert lengths.tolist() == [len(x) + 1 for x in want] and ids.tolist() == [i for x in want for i in (*x, 0)]


@settings(max_examples=60, deadline=None)
@given(PIECES.map("".join), st.lists(st.integers(0, 400), max_size=8))
def test_special_tokens_cut_by_the_ends_of_texts(text, places):
    """One string cut anywhere, inside its special tokens too: each part is a text of its own, in one batch or in two."""
    text = f"a <|endoftext|> b{text}<|endoftext|><|endoftext|>"
    edges = sorted({0, len(text), *(p % len(text) for p in places)})
    texts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    want = [library(t) for t in texts]
    for part, expected in ((texts, want), (texts[: len(texts) // 2], want[: len(texts) // 2]), (texts[len(texts) // 2 :], want[len(texts) // 2 :])):
        raw, offsets = utf8(pa.array(part, pa.string()))
        assert token_counts.count(raw, offsets, token_counts.counter(PATH)).tolist() == [len(x) for x in expected]
        assert dac.encode_texts(raw, offsets, dac.encoder(PATH))[0].tolist() == [i for x in expected for i in (*x, 0)]


def test_special_token_over_two_documents(spark):
    frame = spark.createDataFrame([(1, "a <|end"), (2, "oftext|> b")], "doc_id long, text string").coalesce(1)
    want = [len(library("a <|end")), len(library("oftext|> b"))]
    assert [r["n_tokens"] for r in token_counts.token_counts(frame).orderBy("doc_id").collect()] == want
    assert [(r["start"], r["n_tokens"]) for r in dac.token_file_digest(frame).orderBy("doc_id").collect()] == [(0, want[0] + 1), (want[0] + 1, want[1] + 1)]


def test_merges_of_runs():
    m = token_counts.Merger(PATH)
    words = [b"a" * n for n in range(1, 40)] + [b" " * n for n in range(1, 20)] + [b"0" * 33]
    left = m.survivors(m.symbol[np.frombuffer(b"".join(words), np.uint8)], np.array([len(w) for w in words]))
    assert left.tolist() == [len(load(PATH).model.tokenize("".join(byte_alphabet()[b] for b in w))) for w in words]


def test_token_count_query(spark):
    frame = wide(documents(spark, ODD)).unionByName(wide(documents(spark, ["again", "again"])))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(frame).collect())
    want = sorted((i, len((t or "").encode()), len(library(t)), len(library(t)) > 512) for x in (ODD, ["again", "again"]) for i, t in enumerate(x))
    assert got == want
    assert token_counts.token_counts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[0], [255, 256, 0, 65_535, 65_536, 2**24, 2**32 - 1], list(range(0, 200_000, 37)), [7] * 1500, []])
def test_shard_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    shard = dac.Shard(dac.encode_shard(np.array([5, 9]), np.array([len(ids), 0]), ids))
    assert shard.ids().tolist() == ids.tolist() and shard.doc_ids.tolist() == [5, 9] and shard.lengths.tolist() == [len(ids), 0]
    for i in {0, 1, 511, 512, 513, len(ids) // 2, len(ids) - 1}:
        if 0 <= i < len(ids):
            assert shard[i] == ids[i]
    with pytest.raises(IndexError):
        shard[len(ids)]
    with pytest.raises(ValueError):
        dac.Shard(b"something else")


@pytest.mark.parametrize("shard_ids", [50, dac.SHARD_IDS])
def test_token_files(spark, shard_ids, monkeypatch):
    monkeypatch.setattr(dac.write_shards, "__defaults__", (None, 0, shard_ids))
    frame = wide(documents(spark, [*ODD, "x", "more words here"]))
    got = {r["doc_id"]: r for r in dac.token_file_digest(frame).collect()}
    start = 0
    for i, t in enumerate([*ODD, "x", "more words here"]):
        ids = [*library(t), 0]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert dac.token_file_digest(frame.limit(0)).count() == 0


def test_token_files_of_repeated_and_null_ids(spark):
    frame = spark.createDataFrame([(2, "b"), (2, "a"), (None, "first"), (1, None)], "doc_id long, text string")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in dac.token_file_digest(frame).collect()))
    assert [(d, n) for _, d, n in got] == [(None, 2), (1, 1), (2, 2), (2, 2)]
