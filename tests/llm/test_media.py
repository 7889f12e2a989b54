import hashlib
import zlib

import pytest

from fieldloom.llm import media as M

from .helpers import ODD, documents, wide


def test_images_are_lossless():
    for n in (1, 575, 576, 577, 5000):
        payload = M.padded(bytes(i * 7 % 256 for i in range(n)))
        assert len(payload) % 576 == 0 and M.from_png(M.to_png(payload)).tobytes() == payload
    assert M.padded(b"") == bytes([255]) * 576
    broken = bytearray(M.to_png(M.padded(b"x")))
    broken[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        M.from_png(bytes(broken))


def test_contract(spark):
    texts = [*ODD, "one & <b>two</b>\n\n  three\tfour \n&amp; five\n<!-- six", "same", "same", "é" * 288]
    frame = wide(documents(spark, texts))
    rows = {r["doc_id"]: r for r in M.text_media(frame).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload, r = M.padded(data), rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        image = M.to_png(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), M.features(M.from_png(image)))
        assert r["caption"] == f"{len(data)} bytes"
        lines = [" ".join(x.split()) for x in (t or "").split("\n") if x.strip()]
        half = (len(lines) + 1) // 2
        assert (r["position"], r["n_items"], r["chars_before"]) == (half, len(lines) + 1, sum(map(len, lines[:half])))
    same = [tuple(rows[len(ODD) + 1 + k])[1:] for k in (0, 1)]
    assert same[0] == same[1]
    assert M.text_media(frame.limit(0)).count() == 0
    assert M.text_media(frame.union(frame)).count() == 2 * len(texts)


def test_sequences_and_digest_join(spark):
    image = M.to_png(M.padded(b"hello"))
    name = hashlib.sha256(image).hexdigest()
    html = f'<p>one</p><figure><img src="a" data-digest="{name}"><figcaption>cap</figcaption></figure><p>two</p><img src="gone" data-digest="00">'
    docs = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    items = M.sequences(docs, "id", "html")
    assert [tuple(r) for r in items.orderBy("id", "position").select("id", "position", "kind", "text", "caption").collect()] == [
        (1, 0, "text", "one", None), (1, 1, "media", "", "cap"), (1, 2, "text", "two", None), (1, 3, "media", "", "")
    ]
    store = spark.createDataFrame([(name, bytearray(image))] * 2, "digest string, media binary")
    found = {r["position"]: r["payload_bytes"] for r in M.resolve(items, M.stored_features(store)).collect()}
    assert found == {0: None, 1: 576, 2: None, 3: None}
