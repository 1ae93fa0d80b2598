"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

1. A text is cut into tokens: stretches of letters, digits and bytes above 127, and stretches of other visible bytes. A
   token's hash gives its row among ``WORDS``; four more bits of hash at a time give its index vector, two entries of +1 or -1.
2. Over all documents, every token adds the index vectors of the tokens up to ``REACH`` places away to its own row. The sums
   are whole numbers, so that their order does not matter. Tasks send their tables in blocks; a block's tables are added up
   by salted tasks first, as a stream, then by one. The table has a fixed size of ``WORDS`` x ``DIMS``.
3. Rows are scaled to one length and rounded to whole numbers; a document is the sum of its tokens' rows, so equal texts get
   equal scores. The network sees its mean and spread, how alike
   the rows of neighbours are, and the logarithm of its tokens.
4. The network is fitted on at most ``max_rows`` labelled documents, drawn by a hash of their vector among all
   labelled ones; a fifth of them calibrates a temperature and an offset of the logits by log loss.

Defined cases: null and empty texts have the vector 0 and a score like any other; without labelled rows every score is 0.5;
a null label is not learned; equal vectors with equal labels are learned once, with other labels each; repeated documents are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import bounded_batches, materialize

BITS, DIMS, REACH = 14, 32, 2
WORDS = 1 << BITS
BLOCKS, SALTS = 64, 32
UNIT = 1024
WIDTH = 2 * DIMS + 1 + REACH
SPACE, WORD, MARK = 0, 1, 2
KIND = np.array([SPACE if b in b" \t\n\r\v\f" or b < 32 else WORD if b >= 128 or chr(b).isalnum() else MARK for b in range(256)], np.int8)
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, text that it is in). A token's hash depends on its bytes alone."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    kind = KIND[data]
    edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    ends = np.append(edge[1:], len(data))
    real = kind[edge] != SPACE
    start, end = edge[real], ends[real]
    up, down = powers(ODD, len(data)), powers(BACK, len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * ODD
    h ^= h >> np.uint64(29)
    begins = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    return h, np.searchsorted(begins, start, "right") - 1


def slices(column: pa.Array, most: int = 1 << 22) -> Iterator[list[bytes | None]]:
    """The texts of a column in lists of about ``most`` bytes, a text at least."""
    own, size = [], 0
    for text in column.to_pylist():
        own.append(text)
        size += len(text or b"") + 1
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def add_contexts(table: np.ndarray, texts: list[bytes | None]) -> None:
    """Add the neighbours' index vectors of all tokens to the flat ``table``."""
    h, doc = tokens(texts)
    word = (h & np.uint64(WORDS - 1)).astype(np.int64) * DIMS
    for k in range(2):
        bits = (h >> np.uint64(24 + 8 * k)).astype(np.int64)
        dim, sign = bits % DIMS, 1.0 - 2.0 * (bits // DIMS % 2)
        for gap in range(1, REACH + 1):
            near = doc[gap:] == doc[:-gap]
            at = np.concatenate([(word[:-gap] + dim[gap:])[near], (word[gap:] + dim[:-gap])[near]])
            table += np.bincount(at, np.concatenate([sign[gap:][near], sign[:-gap][near]]), minlength=len(table)).astype(np.int64)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables (block, salt, data) added up by block and salt, as they come."""
    own: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, salt, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = np.frombuffer(data, np.int64)
            if (block, salt) in own:
                own[block, salt] += got
            else:
                own[block, salt] = got.copy()
    for (block, salt), data in own.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["block", "salt", "data"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS, DIMS) whole numbers: rows of about the length ``UNIT``, from the contexts of all documents."""
    schema = "block int, salt int, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WORDS * DIMS, np.int64)
        digest = 0
        for batch in batches:
            for texts in slices(batch.column(0)):
                add_contexts(table, texts)
                digest += sum(len(t or b"") for t in texts)
        own = [x for x in enumerate(np.split(table, BLOCKS)) if x[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([digest % SALTS] * len(own), pa.int32()), pa.array([x.tobytes() for _, x in own], pa.binary())], names=["block", "salt", "data"])

    own = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, schema)
    own = own.repartition("block", "salt").mapInArrow(summed, schema)
    own = own.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(summed, schema)
    table = np.zeros((BLOCKS, WORDS * DIMS // BLOCKS))
    for r in own.collect():
        table[r.block] = np.frombuffer(r.data, np.int64)
    table = table.reshape(WORDS, DIMS)
    table /= np.maximum(np.sqrt((table**2).sum(1, keepdims=True)), 1)
    used = table.any(1)
    if used.any():
        table[used] -= table[used].mean(0)
    return np.rint(table * UNIT).astype(np.int32)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``docs`` without text, with ``vector``: the packed sum of its tokens' rows, their squares, its number of tokens and the
    inner products of neighbours."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).withColumn("vector", F.lit(None).cast("binary")).schema

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows: list[bytes] = []
            for texts in slices(batch.column(len(others))):
                h, doc = tokens(texts)
                word = (h & np.uint64(WORDS - 1)).astype(np.int64)
                out = np.zeros((len(texts), WIDTH), np.int64)
                docs_there, first = np.unique(doc, return_index=True)
                if len(doc):
                    values = own[word]
                    out[docs_there, :DIMS] = np.add.reduceat(values, first, axis=0, dtype=np.int64)
                    for gap in range(1, REACH + 1):
                        like = np.zeros(len(doc), np.int64)
                        like[gap:] = np.einsum("ij,ij->i", values[gap:], values[:-gap], dtype=np.int64) * (doc[gap:] == doc[:-gap])
                        out[docs_there, 2 * DIMS + gap] = np.add.reduceat(like, first)
                    values *= values
                    out[docs_there, DIMS : 2 * DIMS] = np.add.reduceat(values, first, axis=0, dtype=np.int64)
                    out[docs_there, 2 * DIMS] = np.diff(np.append(first, len(doc)))
                rows += [r.tobytes() for r in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(rows, pa.binary())], names=[*others, "vector"])

    return docs.select(*others, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(pool, schema)


def features(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), WIDTH).astype(np.float64)
    size = x[:, 2 * DIMS : 2 * DIMS + 1]
    n = np.maximum(size, 1)
    mean, square = x[:, :DIMS] / n / UNIT, x[:, DIMS : 2 * DIMS] / n / UNIT**2
    alike = x[:, 2 * DIMS + 1 :] / np.maximum(x[:, DIMS : 2 * DIMS].sum(1, keepdims=True), 1)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(size), alike], 1)


class Network:
    """Two layers; inputs are standardised, the logit is calibrated by a temperature and an offset."""

    def __init__(self, inputs: int, hidden: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.normal(0, inputs**-0.5, (inputs, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.temperature, self.offset = 1.0, 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        # sums row by row, so that a row's result does not depend on the rows beside it
        a, b, c, d = self.w
        h = np.tanh(np.einsum("ij,jk->ik", self.standard(x), a) + b)
        return np.einsum("ij,j->i", h, c) + d[0]

    def gradients(self, x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
        """Of the mean log loss over standardised rows, with weight decay of both layers."""
        a, b, c, d = self.w
        h = np.tanh(x @ a + b)
        e = (1 / (1 + np.exp(-(h @ c + d[0]))) - y) / len(y)
        back = np.outer(e, c) * (1 - h * h)
        return [x.T @ back + decay * a, back.sum(0), h.T @ e + decay * c, np.array([e.sum()])]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam over shuffled batches; the rate falls to zero."""
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        x = self.standard(x)
        rng = np.random.default_rng(11)
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                own, t = order[k : k + batch], t + 1
                step = rate * (1 - (t - 1) / steps)
                for i, g in enumerate(self.gradients(x[own], y[own], decay)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature and the offset with the least log loss, on a grid.

        Targets are drawn in by one row of each class (Platt), so that separable rows do not ask for certainty.
        """
        z, ones = self.logits(x), y.sum()
        y = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))

        def loss(at: tuple[float, float]) -> float:
            s = np.clip(z / at[0] + at[1], -30, 30)
            return float(np.mean(np.log1p(np.exp(s)) - y * s))

        grid = [(float(t), float(o)) for t in np.exp(np.linspace(-2, 2.5, 46)) for o in np.linspace(-1.5, 1.5, 31)]
        self.temperature, self.offset = min(grid, key=loss)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.offset, -30, 30)))


def fit(rows: DataFrame, max_rows: int = 20_000, hidden: int = 32) -> Network | None:
    """Learn from the distinct rows (vector, label). At most about ``max_rows`` of them are drawn, by a hash of their vector."""
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).select("vector", F.col("label").cast("int").alias("label")).distinct()
    total = rows.count()
    share = min(1.0, 0.9 * max_rows / total) if total > max_rows else 1.0
    drawn = rows.where(F.pmod(F.xxhash64("vector"), F.lit(2**30)) < F.lit(int(share * 2**30)))
    got = sorted((bytes(r.vector), r.label) for r in drawn.limit(max_rows).collect())
    if not got:
        return None
    x, y = features([v for v, _ in got]), np.array([label == 1 for _, label in got], np.float64)
    held = np.arange(len(got)) % 5 == 4
    net = Network(x.shape[1], hidden)
    net.fit(x[~held], y[~held])
    if held.any():
        net.calibrate(x[held], y[held])
    return net


def score(rows: DataFrame, net: Network | None) -> DataFrame:
    """``rows`` with score in place of vector."""
    names = [c for c in rows.columns if c != "vector"]
    schema = rows.select(*names).withColumn("score", F.lit(0.5)).schema
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = batch.column(len(names)).to_pylist()
            p = np.full(len(got), 0.5) if own is None or not got else own.scores(features(got))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p)], names=[*names, "score"])

    return rows.select(*names, "vector").mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels are learned from documents that are not held out."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    vectors = materialize(pooled(own, word_vectors(docs)), "quality-vectors")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    net = fit(vectors.where(~F.col("held_out")).join(given, "doc_id"))
    return score(vectors, net).withColumn("predicted", (F.col("score") >= least).cast("int"))
