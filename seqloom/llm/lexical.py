"""Ranked lexical search: documents by integer impact scores, found through buckets of vector lengths.

A document is a sparse vector of impacts, an item one of term weights, and the score is their inner product. The search
is exact and keeps whole results:

1. One scan cuts every text into terms and keeps, of each document, its length and its counts of the terms that items have.
2. From the sums over all documents come the weights and, per document, the impacts and the vector's length. Vectors are
   dealt by ranges of that length, longest first, and written with it, so that a filter on the length skips files.
3. The range of the longest vectors gives every item a first threshold: the score that ten documents reach at least.
4. Each task walks through its vectors in buckets of falling length. Cauchy-Schwarz drops a bucket for an item if the
   longest vector in it, times the item's, stays under the threshold. Inside a bucket the coordinates that weigh most in
   the item are summed exactly, and the rest is bounded by what is left of both lengths. What survives is scored in
   64-bit integers, and raises the item's threshold.
5. The best of each task meet in one window per item, at most ``best`` rows a task.

Items come to the tasks in blocks of about ``block_chars`` characters; each block takes one scan of the texts.

Defined cases: a null text has no terms; an item without terms or without a hit gives no row; repeated rows of an item
(same item_id and text) count once, rows with the same item_id and other texts are ranked each on its own; repeated rows of
a document are ranked one after the other; a null doc_id comes after the others of its score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.lineage import discard, materialize

#: what separates terms is a space; A-Z are lower-cased; bytes of other scripts stay
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCALE = 1_000_000_000
BUCKET = 2048  # vectors
SLACK = 1 + 1e-9  # of bounds in doubles


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct items in blocks of about ``block_chars`` characters, dealt by a hash of their text."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        yield sorted(((r.item_id, r.text.encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), at and tf (of the vocabulary's terms, packed) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, at, tf = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                seen = Counter(words)
                own = sorted((known[w], seen[w]) for w in known.keys() & seen.keys())
                n.append(len(words))
                at.append(np.array([k for k, _ in own], np.int32).tobytes())
                tf.append(np.array([k for _, k in own], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "at", "tf"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(count, "doc_id long, n long, at binary, tf binary")


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(seen[own])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counts.select("at").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def vectors(counts: DataFrame, number: int, total: int) -> DataFrame:
    """doc_id, at, impact (64-bit, packed) and length of every document that has a term of the vocabulary."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            impact, length = [], []
            for n, tf in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m = 100 - 75 + (75 * n * number) // total
                own = np.frombuffer(tf, np.int32).astype(np.int64)
                own = SCALE * own // (1000 * own + 8 * m)
                impact.append(own.tobytes())
                length.append(math.sqrt(float((own.astype(np.float64) ** 2).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(impact, pa.binary()), pa.array(length, pa.float64())], names=["doc_id", "at", "impact", "length"])

    return counts.where("octet_length(at) > 0").mapInArrow(weigh, "doc_id long, at binary, impact binary, length double")


class Bucket:
    """Vectors of similar length, readable by coordinate."""

    def __init__(self, ids: list[int | None], at: list[bytes], impact: list[bytes], length: np.ndarray) -> None:
        self.ids, self.length = ids, length
        sizes = np.array([len(a) >> 2 for a in at])
        where, value = np.frombuffer(b"".join(at), np.int32), np.frombuffer(b"".join(impact), np.int64)
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(where, kind="stable")
        self.row, self.value, where = row[order], value[order], where[order]
        self.terms, first = np.unique(where, return_index=True)
        self.start = np.append(first, len(where))

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, impacts) of a coordinate."""
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return self.row[:0], self.value[:0]
        return self.row[self.start[k] : self.start[k + 1]], self.value[self.start[k] : self.start[k + 1]]


class Query:
    """An item's weighted terms, heaviest first, and the best documents so far as (-score, null id, id)."""

    def __init__(self, weights: dict[int, int], least: int, best: int) -> None:
        own = sorted(((w, t) for t, w in weights.items() if w > 0), reverse=True)
        self.terms, self.weights = [t for _, t in own], [w for w, _ in own]
        squares = np.array(self.weights, np.float64) ** 2
        self.rest = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))  # length from each coordinate on
        self.least, self.best, self.found = least, best, []

    def search(self, bucket: Bucket, focus: int = 8) -> None:
        n = len(bucket.ids)
        if not self.terms or self.rest[0] * bucket.length[0] * SLACK < self.least:
            return
        score, square = np.zeros(n, np.int64), np.zeros(n)
        for t, w in zip(self.terms[:focus], self.weights[:focus], strict=True):
            row, value = bucket.column(t)
            score[row] += w * value
            square[row] += value.astype(np.float64) ** 2
        left = np.sqrt(np.maximum(bucket.length**2 * SLACK - square, 0))
        live = (score + self.rest[min(focus, len(self.terms))] * left) * SLACK >= max(self.least, 1)
        if not live.any():
            return
        for t, w in zip(self.terms[focus:], self.weights[focus:], strict=True):
            row, value = bucket.column(t)
            score[row] += w * value
        live = np.flatnonzero(live & (score >= max(self.least, 1)))
        if len(live) > self.best:
            cut = np.partition(score[live], -self.best)[-self.best]
            live = live[score[live] >= cut]
        self.found = sorted(self.found + [(-int(score[k]), bucket.ids[k] is None, bucket.ids[k] or 0) for k in live])[: self.best]
        if len(self.found) == self.best:
            self.least = max(self.least, -self.found[-1][0])


def run_queries(items: list[dict[int, int]], least: list[int], best: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int]]:
    """(item, doc_id, score) of the best documents of each item among the batches (doc_id, at, impact, length)."""
    queries = [Query(w, t, best) for w, t in zip(items, least, strict=True)]
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            own = batch.slice(k, size)
            ids, at, impact = (own.column(c).to_pylist() for c in range(3))
            length = own.column(3).to_numpy()
            order = np.argsort(-length, kind="stable")
            bucket = Bucket([ids[i] for i in order], [at[i] for i in order], [impact[i] for i in order], length[order])
            for q in queries:
                q.search(bucket)
    for k, q in enumerate(queries):
        for score, missing, i in q.found:
            yield k, None if missing else i, -score


def search(docs: DataFrame, items: DataFrame, best: int = 10, block_chars: int = 4_000_000, bucket: int = BUCKET) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0, equal ones by doc_id."""
    out = None
    for block in item_blocks(items, block_chars):
        found = _search(docs, block, best, bucket)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, block: list[tuple[int | None, bytes]], best: int, bucket: int) -> DataFrame:
    spark = docs.sparkSession
    own = [Counter(terms(text)) for _, text in block]
    vocabulary = {w: k for k, w in enumerate(sorted(set().union(*own)))}
    counts = materialize(counted(docs, vocabulary), "lexical-counts")
    number, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(counts, len(vocabulary))
    weight = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * int(df[k]) + 1))) for t, k in vocabulary.items()}
    weights = [{vocabulary[t]: n * weight[t] for t, n in c.items()} for c in own]
    parts = max(counts.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = vectors(counts, number, max(total, 1)).repartitionByRange(parts, F.desc("length"), F.xxhash64("doc_id"))
    index = materialize(ranged.sortWithinPartitions(F.desc("length")).withColumn("part", F.spark_partition_id()), "lexical-index")
    discard(counts)

    def best_of(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = list(run_queries(*shared.value, best, bucket, batches))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

        return rows.select("doc_id", "at", "impact", "length").mapInArrow(run, "item int, doc_id long, score long")

    # any documents give a true threshold; the range of the longest vectors gives a high one
    head = best_of(index.where("part = 0"), spark.sparkContext.broadcast((weights, [0] * len(block))))
    reached = head.groupBy("item").agg(F.collect_list("score").alias("scores"))
    top = {r.item: sorted(r.scores, reverse=True)[:best] for r in reached.collect()}
    least = [min(top[k]) if len(top.get(k, ())) == best else 0 for k in range(len(block))]
    lengths = [math.sqrt(sum(float(w) ** 2 for w in c.values())) for c in weights]
    shortest = min((t / (x * SLACK) for t, x in zip(least, lengths, strict=True) if x > 0), default=0.0)
    found = best_of(index.where(F.col("length") >= shortest * (1 - 1e-9)), spark.sparkContext.broadcast((weights, least)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
