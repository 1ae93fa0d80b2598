"""Interleaved document sequences: HTML gives ordered text and media references; digests resolve the payloads.

Media are kept once per stored row in a table ``(digest, n_bytes, media)``. The stored form is RIFF/WAVE with unsigned
8-bit mono samples, one sample a payload byte, so it is lossless. Payloads never travel through a join: features are
computed where the stored bytes are read, and only those meet the references.

Defined cases: a null or empty text is a payload of 64 zero bytes; null HTML is an empty sequence; a reference without
a stored payload keeps its place with null features; equal payloads have equal digests and values.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.plans.lineage import materialize

UNIT = 64
SEQUENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("digest", T.StringType()),
            T.StructField("caption", T.StringType()),
        ]
    )
)
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA_TAGS = {"img", "audio", "video", "source", "embed"}
HIDDEN_TAGS = {"script", "style", "template", "noscript"}


class _Sequence(HTMLParser):
    """Collects text runs and media references in page order; a figure's caption goes to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS:
            own = dict(attrs)
            found = re.fullmatch(r"media:([0-9a-f]+)", own.get("src") or "")
            self.flush()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"kind": "media", "text": None, "digest": found[1] if found else None, "caption": own.get("alt")})
        elif tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "section", "article"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for k in self.figure or []:
                self.items[k]["caption"] = text
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "section", "article"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"pos": k} | item for k, item in enumerate(parser.items)]


def sequences(pages: DataFrame, html: str = "html", out: str = "sequence") -> DataFrame:
    """``pages`` with an array of (pos, kind, text, digest, caption) structs in page order."""

    @F.pandas_udf(SEQUENCE)
    def parse(column: pd.Series) -> pd.Series:
        return column.map(parse_sequence, na_action=None)

    return pages.withColumn(out, parse(F.col(html).cast("string")))


def pack(payload: bytes) -> bytes:
    """The payload as a RIFF/WAVE file of unsigned 8-bit mono samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def unpack(media: bytes) -> bytes:
    """The samples of a stored file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def describe(payload: bytes) -> str:
    """Integer features of the samples: count, sum, sum of squares, sign changes about 128, distinct values, commonest value."""
    x = np.frombuffer(payload, np.uint8)
    seen = np.bincount(x, minlength=256)
    value = np.arange(256)
    changes = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"n={x.size};sum={int(seen @ value)};sq={int(seen @ value**2)};changes={changes};distinct={int(np.count_nonzero(seen))};mode={int(seen.argmax())}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Write every text's padded payload as media; rows (digest of the text's bytes, n_bytes, media)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [(x or "").encode() for x in batch.column(0).slice(at, 256).to_pylist()]
                media = [pack(x + bytes(-len(x) % UNIT or (0 if x else UNIT))) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())],
                    names=["digest", "n_bytes", "media"],
                )

    return materialize(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(write, "digest string, n_bytes long, media binary"), "media")


def features(stored: DataFrame) -> DataFrame:
    """Read stored media back; one row a digest with what was read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = unpack(media)
                rows.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)

    names = ["digest", "n_bytes", *(x.split()[0] for x in FEATURES.split(", "))]
    return stored.select("digest", "n_bytes", "media").mapInArrow(read, f"digest string, n_bytes long, {FEATURES}").dropDuplicates(["digest"])


def resolve(seqs: DataFrame, key: list[str], found: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row a media reference: key, pos, digest, caption and the features of its payload (null if not stored)."""
    refs = seqs.select(*key, F.explode(F.filter(sequence, lambda x: x["kind"] == "media")).alias("item"))
    return refs.select(*key, "item.pos", "item.digest", "item.caption").join(found, "digest", "left")


def document_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, html): every text as a page of its lines, with its medium as a figure between the first and the second half."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines, half = F.split(safe, "\n"), (F.size(F.split(safe, "\n")) / 2).cast("int")
    figure = F.concat(F.lit('<figure><img src="media:'), F.sha2(text, 256), F.lit('"><figcaption>'), F.char_length(text).cast("string"), F.lit(" characters</figcaption></figure>"))
    paragraphs = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    rest = F.slice(lines, half + 1, F.size(lines) - half)
    return docs.select("doc_id", F.concat(paragraphs(F.slice(lines, F.lit(1), half)), figure, paragraphs(rest)).alias("html"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Each document as a page of its lines with a figure whose medium is its text; the stored bytes are read back and described.

    Beside the digests: ``pos`` and ``caption`` of the reference in the sequence, ``n_items`` in it, and ``texts_sha256``
    of its text runs in page order, joined by newlines.
    """
    seqs = sequences(document_pages(docs))
    runs = F.transform(F.filter("sequence", lambda x: x["kind"] == "text"), lambda x: x["text"])
    seqs = seqs.select("doc_id", F.size("sequence").cast("long").alias("n_items"), F.sha2(F.array_join(runs, "\n"), 256).alias("texts_sha256"), "sequence")
    met = resolve(seqs, ["doc_id", "n_items", "texts_sha256"], materialize(features(store(docs)), "media-features"))
    return met.select("doc_id", "n_bytes", *(x.split()[0] for x in FEATURES.split(", ")), "pos", "caption", "n_items", "texts_sha256")
