"""Media columns: interleaved document sequences.

An HTML document is parsed to an ordered sequence of text blocks and media references; a reference names its payload by
digest. Payloads are stored once a digest, as 8-bit greyscale PNG images in a Parquet table in the shared folder, and a
join by digest resolves the references. Positions say where text and media stand, and captions stay with their media.

``text_media`` applies this to a text table: the padded UTF-8 bytes of each text are the samples of an image. The text's
lines are the paragraphs of an HTML document, which refers to the image after the first half of them; parsing it gives the
sequence of paragraphs and image, in which the image's position, its caption and the characters before it are reported.
Features are computed from the bytes as they are read back.

Defined results: a null or empty text is one row of padding; equal texts share one stored image; repeated rows repeat; a
reference whose digest isn't stored resolves to nulls; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.html_blocks import scan
from fieldloom.llm.shared import Workspace
from fieldloom.llm.text_kernel import relieved, utf8

UNIT = 576
PAD = 255
#: Samples in a row of an image.
WIDTH = 24
#: The compressor's level; any level is lossless.
LEVEL = 1
#: Bytes of images and documents that are sent on at a time.
OUT_BYTES = 8_000_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "position int, kind string, text string, source string, digest string, caption string"
DOCUMENT_SCHEMA = "doc_id long, n_bytes long, position int, n_items int, chars_before long, caption string, digest string, media binary"
STORE_SCHEMA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes([PAD]) * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG whose samples are the payload, row by row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each row after its filter type, 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of a PNG that ``to_png`` wrote, as rows; checks signature and checksums."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, shape, body = 8, None, b""
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk of the image is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", data)
            if (depth, colour, *rest) != (8, 0, 0, 0, 0):
                raise ValueError("not an 8-bit greyscale image")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            body += data
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("the image's rows are filtered")
    return lines[:, 1:]


def features(samples: np.ndarray) -> str:
    """Shape, mean, deviation and entropy of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n = counts.sum()
    value = np.arange(256)
    mean = float((counts * value).sum() / n)
    deviation = float(np.sqrt(max(0.0, (counts * value * value).sum() / n - mean * mean)))
    share = counts[counts > 0] / n
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};sd={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def interleaved(html: str | None) -> list[dict]:
    """The ordered sequence of a document: text blocks outside captions, and media with theirs."""
    page = scan(html) if html else None
    out: list[dict] = []
    if page is None:
        return out
    media = iter(page.media)
    following = next(media, None)
    for k in range(len(page.blocks) + 1):
        while following is not None and following.after_blocks == k:
            out.append({"kind": "media", "text": following.alt, "source": following.source, "digest": following.digest or None, "caption": following.caption})
            following = next(media, None)
        if k < len(page.blocks) and page.blocks[k].tag != "figcaption":
            out.append({"kind": "text", "text": page.blocks[k].text, "source": None, "digest": None, "caption": None})
    return [{"position": i, **x} for i, x in enumerate(out)]


def sequences(documents: DataFrame, key: str, html: str) -> DataFrame:
    """``key, position, kind, text, source, digest, caption`` of every item of every document's sequence."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["position", "kind", "text", "source", "digest", "caption"]
        for batch in batches:
            found = [interleaved(x) for x in batch.column(1).to_pylist()]
            row = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            columns = [pa.array([y[n] for x in found for y in x], pa.int32() if n == "position" else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), *columns], [key, *names])

    return documents.select(key, html).mapInArrow(relieved(run), f"`{key}` {kind}, {ITEM}")


def stored_features(store: DataFrame) -> DataFrame:
    """One row for each digest of ``store(digest, media)``, read back and checked against the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = held.as_py()
                sha = hashlib.sha256(media).hexdigest()
                if sha != name:
                    raise ValueError(f"the media stored as {name} have the digest {sha}")
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((name, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha, features(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    # tasks may have stored one digest each; their rows agree
    return store.select("digest", "media").mapInArrow(relieved(run), STORE_SCHEMA).dropDuplicates(["digest"])


def resolve(items: DataFrame, features: DataFrame) -> DataFrame:
    """``items`` with ``features`` (a row a digest) of each reference; text items and unknown digests get nulls.

    Features that were written before the join leave it free to split a digest that very many items refer to.
    """
    return items.join(features, "digest", "left")


def document(text: str, name: str, n_bytes: int) -> str:
    """The HTML of a text: a paragraph for each line that isn't blank, and the figure after the first half of them."""
    lines = [escape(x, False) for x in text.split("\n") if x and not x.isspace()]
    half = (len(lines) + 1) // 2
    figure = f'<figure><img src="sha256:{name}" data-digest="{name}" alt="text bytes"><figcaption>{n_bytes} bytes</figcaption></figure>'
    return f"<article>{''.join(f'<p>{x}</p>' for x in lines[:half])}{figure}{''.join(f'<p>{x}</p>' for x in lines[half:])}</article>"


def _documents(docs: DataFrame) -> DataFrame:
    """The media item of each document's sequence, with the image where the task hasn't stored it already.

    The sequence is parsed where the document is made, as its text stands in the input already.
    """
    names = [x.split()[0] for x in DOCUMENT_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            data = raw.tobytes()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = to_png(padded(data[a:b]))
                sha = hashlib.sha256(media)
                new = sha.digest() not in known
                known.add(sha.digest())
                items = interleaved(document(data[a:b].decode(errors="replace"), sha.hexdigest(), b - a))
                before = 0
                for item in items:
                    if item["kind"] == "media":
                        rows.append((doc_id, b - a, item["position"], len(items), before, item["caption"], item["digest"], media if new else None))
                        break
                    before += len(item["text"])
                held += len(media) if new else 0
                if held >= OUT_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if len(known) > 1_000_000:
                known.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(relieved(run), DOCUMENT_SCHEMA)


def text_media(docs: DataFrame) -> DataFrame:
    """The stored image of each row of ``docs(doc_id, text)`` and its features, through an interleaved document.

    ``position`` is the image's place in the sequence of ``n_items`` paragraphs and image, ``chars_before`` the characters
    of the paragraphs before it, their white space collapsed.
    """
    work = Workspace(docs.sparkSession, "media")
    written = work.keep(_documents(docs), "documents")
    store = written.where("media is not null").select("digest", "media")
    features = work.keep(stored_features(store), "features")
    return resolve(written.drop("media"), features).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "n_items", "chars_before", "caption"
    )
