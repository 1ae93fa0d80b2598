"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text (runs of other characters than letters count as one space)
are hashed to ``DIMS`` columns. A value is the n-gram's share of the document times its inverse document frequency,
counted over every document that may be learned from. Weights come from follow-the-regularised-leader with elastic-net
penalties over a bounded sample (``per_language`` documents a language, drawn by hash), and a temperature fitted on a
fifth of the sample calibrates the scores. Whole texts are read for counts, fitting and prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows all are ``und``;
equal texts get equal results; a null label is not learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import bounded_batches

BITS = 16
DIMS = 1 << BITS
ORDERS = (1, 2, 3)
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(text: str) -> np.ndarray:
    """Columns of all n-grams of a text, with repeats."""
    c = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], c * MIX
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * STEP + c[n - 1 :] * MIX
        out.append((((h ^ (h >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (DIMS, languages), times the inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, text: str) -> np.ndarray:
        g = grams(text)
        z = (self.weights[g].sum(0, dtype=np.float64) / len(g) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, and how many texts there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, mark, n = np.zeros(DIMS, np.int64), np.zeros(DIMS, bool), 0
        for batch in batches:
            for text in batch["text"]:
                mark[grams(text)] = True
                own = np.flatnonzero(mark)
                seen[own] += 1
                mark[own] = False
                n += 1
        own = np.flatnonzero(seen)
        yield pd.DataFrame({"column": np.append(own, DIMS), "n": np.append(seen[own], n)})

    rows = docs.select("text").mapInPandas(count, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIMS + 1, np.int64)
    df[rows["column"]] = rows["n"]
    return df[:DIMS], int(df[DIMS])


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (DIMS + 1, classes); the last row is the bias. Rows of ``x``: columns and their values."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            at, v = x[i]
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    return weights(np.arange(DIMS + 1))


def fit(docs: DataFrame, label: str = "lang", per_language: int = 800, max_rows: int = 8_000, epochs: int = 3, scale: float = 20.0) -> Model | None:
    """Learn from ``docs`` (text, label). About ``per_language`` distinct texts a language and at most ``max_rows`` in all are
    fitted on, drawn by a hash of the text; copies of a drawn text count once."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    quota = min(per_language, max(1, max_rows // len(languages)))
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [np.unique(grams(t), return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "turn": batch["turn"], "at": [a.tobytes() for a, _ in got], "n": [c.astype(np.int32).tobytes() for _, c in got]})

    chance = F.create_map(*(F.lit(v) for k in languages for v in (k, min(1.0, quota / counts[k]))))
    u = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2**30)) / F.lit(float(2**30))
    drawn = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("turn", u / chance[F.col("label")]).where("turn < 1")
    drawn = drawn.groupBy("label", "turn").agg(F.min("text").alias("text"))
    got = drawn.mapInPandas(sample, "label string, turn double, at binary, n binary").orderBy("turn").limit(max_rows).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["label", "at", "n"], kind="stable")
    y = np.searchsorted(languages, got["label"])
    x = []
    for a, c in zip(got["at"], got["n"], strict=True):
        at, n = np.frombuffer(a, np.int32), np.frombuffer(c, np.int32)
        x.append((np.append(at, DIMS), np.append(scale * n / n.sum() * idf[at], 1.0).astype(np.float32)))
    del got
    held = np.arange(len(x)) % 5 == 4
    w = ftrl([r for r, h in zip(x, held, strict=True) if not h], y[~held], len(languages), epochs, 0.5, 1.0, 0.002, 0.001)
    logits = np.array([v @ w[at] for at, v in (x[i] for i in np.flatnonzero(held))])
    model = Model(languages, (w[:DIMS] * idf[:, None] * scale).astype(np.float32), w[DIMS])
    if len(logits):
        model.temperature = temperature(logits, y[held])
    return model


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, on a grid in logarithms."""

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return float(min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def of(column: pd.Series) -> pd.DataFrame:
        out = []
        for t in column:
            if model is None or t is None or not LETTER.search(t):
                out.append(("und", 0.0))
            else:
                p = model.scores(t)
                out.append((model.languages[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score"))).alias("own"), of(F.col(text).cast("string")).alias("found"))
    return rows.select("own.*", "found.*")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    model = fit(base.where(~F.col("held_out")))
    return predict(base.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a recognised language; learned from their own labels. Same columns, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), "text")
    marked = predict(rows, fit(docs.select("text", "lang")))
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("own.*")
