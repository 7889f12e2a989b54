import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import language_id as L

from .helpers import ODD, documents, wide


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=30), st.text("abcd", max_size=40))
def test_automaton_accepts_substrings_and_phrases_are_greedy(sample, text):
    table = L.Automaton([ord(c) - 96 for c in sample]).table(8)

    def accepts(x):
        s = 0
        for c in x:
            s = table[s, ord(c) - 96]
            if not s:
                return False
        return True

    assert all(accepts(text[i:j]) == (text[i:j] in sample) for i in range(len(text)) for j in range(i + 1, len(text) + 1))
    model = L.Classifier({"x": sample or " "})
    if not model.names:
        return
    # phrases end where the next symbol leaves the sample; that symbol begins the next phrase
    count, held = 1, ""
    for c in text:
        if held + c in sample:
            held += c
        else:
            count, held = count + 1, c if c in sample else ""
    codes, offsets = model.symbols(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]))
    if text:
        assert model.phrases(codes, offsets)[0, 0] == count


def test_prediction_ignores_the_batch(spark):
    g = random.Random(1)
    samples = {k: L.normalise(" ".join(g.choice(v) for _ in range(2000))) for k, v in {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "drei", "schön"]}.items()}
    model = L.Classifier(samples)
    texts = ["Lorem, IPSUM dolor!", "zwei schön", "x" * 3000, "ipsum " * 900, "schön"] + [t or "" for t in ODD]
    together = L.predict_column(model, pa.array(texts))
    alone = [L.predict_column(model, pa.array([t])) for t in texts]
    assert together[0] == [a[0][0] for a in alone] and np.allclose(together[1], [a[1][0] for a in alone])
    assert together[0][:2] == ["aa", "bb"] and together[0][3] == "aa"


def test_contract(spark):
    frame = wide(documents(spark, ODD)).selectExpr("*", "cast(null as string) as lang")
    rows = L.language_id(frame).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert L.language_id(frame.limit(0)).count() == 0
    learned = documents(spark, ["hello there world"] * 8 + [None, "", "12 34 !!", "Καλημέρα"]).selectExpr("*", "'en' as lang")
    found = {r["doc_id"]: r for r in L.language_id(learned).collect()}
    assert [found[i]["lang_pred"] for i in (0, 8, 9, 10, 11)] == ["en", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) as a", "count(*) as n").first()
    assert found["a"] >= 0.97 and found["n"] > 200


def greedy(sample, text):
    count, held = 1, ""
    for c in text:
        if held + c in sample:
            held += c
        else:
            count, held = count + 1, c if c in sample else ""
    return count


def test_long_texts_are_parsed_whole():
    """No phrase is added inside a long text, whether it steps with others or is finished alone."""
    g = random.Random(4)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    sample = " ".join(g.choice(words) for _ in range(300))
    texts = [" ".join(g.choice([*words, "xyz", "rol"]) for _ in range(n)) for n in [900, 400, 1, 2, *range(3, 60)]]
    model = L.Classifier({"x": sample})
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    symbols, offsets = model.symbols(codes, np.cumsum([0, *map(len, texts)]))
    assert model.phrases(symbols, offsets)[:, 0].tolist() == [greedy(sample, t) for t in texts]


def test_two_scripts_of_many_letters():
    """Every letter of the samples counts, far beyond those that have a symbol of their own."""
    g = random.Random(2)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(3000)], "bb": [chr(0xAC00 + i) for i in range(3000)], "cc": [chr(0x4E00 + 3000 + i) for i in range(3000)]}
    model = L.Classifier({k: " ".join("".join(g.choices(v, k=5)) for _ in range(4000)) for k, v in scripts.items()})
    texts = [(k, " ".join("".join(g.choices(v, k=4)) for _ in range(12))) for k, v in scripts.items() for _ in range(60)]
    names, _ = L.predict_column(model, pa.array([t for _, t in texts]))
    assert names == [k for k, _ in texts]


def test_repeated_labelled_rows(spark):
    """A language of one text, repeated, is learned as well as others, and its copies bring no more than one text."""
    texts = {"en": "the house by the river", "fr": "la maison près de la rivière", "de": "das Haus am Fluss", "es": "la casa junto al río"}
    rows = [(i, texts[k], k) for i, k in enumerate(k for k in texts for _ in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    samples = L.training_samples(docs, ~L.held_out())
    assert samples == {k: L.normalise(t) for k, t in texts.items()}
    found = L.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang <> lang_pred").count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"{'abcdefghij'[i // 30]}{'klmnopqrst'[i % 10]}{'uvwxyz'[i % 6]} " * 5, f"l{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(L.training_samples(docs, L.F.lit(True))) == 300
