"""Substring dedup by sliding sentence spans.

A span is any run of at least MIN_SENTENCES consecutive sentences with MIN_WORDS words, so that chance repeats of short
phrases do not count. Spans are compared lower-cased with white space folded, by 128-bit hashes joined over all documents.
The first occurrence of a span is the one with the smallest (doc_id, sentence); sentences that any non-first occurrence
covers are removed. Only the shortest span from every sentence on and the shortest one up to every sentence are hashed:
those inside a longer span cover it, and none of them is a first occurrence where the longer one is not.

Sentences end at the stops of many scripts and at line ends. Words lie between white space; in scripts without spaces two
Han or kana characters, or four Thai, Lao, Khmer or Burmese ones, count as one.

Only hashes and positions shuffle; hashes are counted with partial sums, so a span that a third of all documents share
is no hot group, and texts shuffle only for documents that lose something.

Defined cases: null or empty texts have no sentences; texts with fewer sentences or words than a span lose nothing;
rows that repeat a doc_id and its text are one document; among other rows with equal doc_id the text's hash decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.marks import maybe_in
from seqloom.llm.suffixes import documents_by_row
from seqloom.plans.lineage import materialize

MIN_SENTENCES, MIN_WORDS = 2, 16
ENDS = ".!?\n\u2028\u2029\u3002\uff01\uff1f\uff61\uff0e\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u17d4\u17d5\u104b\u0f0d"
SENTENCE = re.compile(rf"[^{ENDS}]*[{ENDS}]+\s*|[^{ENDS}]+")
HAN = re.compile("[\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
THAI = re.compile("[\u0e01-\u0eff\u1000-\u104a\u1780-\u17d3]")


def split(text: str | None) -> list[str]:
    """Sentences with the white space behind them; together they are the text."""
    return SENTENCE.findall(text or "")


def n_words(sentence: str, own: list[str]) -> int:
    """Words of a sentence that white space splits into ``own``."""
    if sentence.isascii() or not (HAN.search(sentence) or THAI.search(sentence)):
        return len(own)
    rest, han = HAN.subn(" ", sentence)
    rest, thai = THAI.subn(" ", rest)
    return (han + 1) // 2 + (thai + 3) // 4 + sum(any(c.isalnum() for c in x) for x in rest.split())


def spans(text: str | None, least: int = MIN_SENTENCES, words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int]]:
    """(first sentence, end, two halves of the hash) of the shortest spans from and up to every sentence. Sentences without a word count for nothing."""
    at, kept, upto = [], [], [0]
    for k, s in enumerate(split(text)):
        if own := s.lower().split():
            at.append(k)
            kept.append(" ".join(own))
            upto.append(upto[-1] + n_words(s, own))

    def span(i: int, j: int) -> tuple[int, int, int, int]:
        h = xxhash.xxh3_128_digest("\n".join(kept[i:j]))
        return at[i], at[j - 1] + 1, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)

    ends, j = {}, 0
    for i in range(len(kept)):
        while j < len(kept) and (j - i < least or upto[j] - upto[i] < words):
            j += 1
        if j - i < least or upto[j] - upto[i] < words:
            break
        ends[i] = j
        yield span(i, j)
    i = 0
    for j in range(least, len(kept) + 1):
        while j - i - 1 >= least and upto[j] - upto[i + 1] >= words:
            i += 1
        if upto[j] - upto[i] >= words and ends[i] != j:
            yield span(i, j)


def dedup(docs: DataFrame, least: int = MIN_SENTENCES, words: int = MIN_WORDS) -> DataFrame:
    """Rows of documents that lose sentences: doc_id, first_doc_ids (where their spans occur first), n_sentences, n_removed, removed (sentence ranges), kept."""
    own = documents_by_row(docs)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = [(d, t, *s) for d, t, x in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True) for s in spans(x, least, words)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "th", "i", "j", "h1", "h2"])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    every = own.select("doc", "th", "text").mapInArrow(hashes, "doc long, th long, i int, j int, h1 long, h2 long")
    every = materialize(every, "sentence-spans")
    first = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "i")).alias("f")).where("n > 1").select("h1", "h2", F.col("f.doc").alias("fdoc"), F.col("f.th").alias("fth"), F.col("f.i").alias("fi"))
    first = materialize(first, "first-spans")  # a table of its own lets the join split a span that very many documents share
    later = every.join(first, ["h1", "h2"]).where("doc <> fdoc or th <> fth or i <> fi")
    lost = materialize(later.groupBy("doc", "th").agg(F.collect_set(F.struct("i", "j")).alias("spans"), F.array_sort(F.collect_set("fdoc")).alias("first_doc_ids")), "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sentences, gone = split(text), set()
                for x in found:
                    gone.update(range(x["i"], x["j"]))
                removed = ",".join(f"{a}-{b}" for a, b in ranges(sorted(gone)))
                rows.append({"doc_id": doc_id, "first_doc_ids": firsts, "n_sentences": len(sentences), "n_removed": len(gone), "removed": removed, "kept": "".join(s for k, s in enumerate(sentences) if k not in gone)})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("first_doc_ids", pa.list_(pa.int64())), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.string()), ("kept", pa.string())])
    touched = own.where(maybe_in(lost, "doc", "th")).join(lost, ["doc", "th"]).select("doc_id", "text", "spans", "first_doc_ids")
    return touched.mapInArrow(cut, "doc_id long, first_doc_ids array<long>, n_sentences int, n_removed int, removed string, kept string")


def ranges(own: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k in own:
        if out and out[-1][1] == k:
            out[-1] = (out[-1][0], k + 1)
        else:
            out.append((k, k + 1))
    return out
