"""Masked evaluation of predictions, roll-ups, error rates, set differences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import packed

EPS = 1e-7


def confusion(df: DataFrame, by: list[str], pred: str = "pred", label: str = "label", mask: str = "mask") -> DataFrame:
    """tp, pp, ap, total and precision, recall, f1 with a small number in the denominators, over masked rows."""
    p, t, m = F.col(pred), F.col(label), F.col(mask)
    counts = df.groupBy(*by).agg(F.count_if(m & p & t).alias("tp"), F.count_if(m & p).alias("pp"), F.count_if(m & t).alias("ap"), F.count_if(m).alias("total"))
    rates = counts.withColumn("precision", F.col("tp") / (F.col("pp") + EPS)).withColumn("recall", F.col("tp") / (F.col("ap") + EPS))
    return rates.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPS))


def confusion_ranges(pred: DataFrame, truth: DataFrame, bounds: DataFrame) -> DataFrame:
    """Unmasked rates of address lists (path, addr) over [start, end), weighted by its length; repeats count once."""
    flags = pred.select("path", "addr", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select("path", "addr", F.lit(0).alias("p"), F.lit(1).alias("t")))
    one = flags.groupBy("path", "addr").agg(F.max("p").alias("p"), F.max("t").alias("t")).join(bounds, "path").where("addr >= start and addr < end")
    return _ranged(bounds, one.groupBy("path").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("pp"), F.sum("t").alias("ap")))


def confusion_ranges_of(contents: packed.Contents, bounds: DataFrame) -> DataFrame:
    """``confusion_ranges`` where predictions (pred), the truth (label: path, off) and bounds (path, start, end) follow from a row each."""

    def count(given: dict[str, packed.Arrays]) -> packed.Arrays:
        own = given["bounds"]
        start, end = (np.zeros(int(own["path"].max(initial=-1)) + 1, np.int64) for _ in range(2))
        start[own["path"]], end[own["path"]] = own["start"], own["end"]
        keys = []
        for name in ("pred", "label"):
            path, off = given[name]["path"], given[name]["off"]
            inside = (off >= start[path]) & (off < end[path])
            keys.append(np.unique(packed.keys_of(path[inside], off[inside])))
        keys.append(np.intersect1d(*keys, assume_unique=True))
        pp, ap, tp = (np.bincount(k >> 32, minlength=len(start)) for k in keys)
        return {"path": np.arange(len(start)), "tp": tp, "pp": pp, "ap": ap}

    return _ranged(bounds, contents.in_tasks(count, "path string, tp long, pp long, ap long"))


def _ranged(bounds: DataFrame, counts: DataFrame) -> DataFrame:
    every = bounds.join(counts, "path", "left").select("path", (F.col("end") - F.col("start")).alias("total"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "pp", "ap")))
    return every.withColumn("precision", F.col("tp") / (F.col("pp") + EPS)).withColumn("recall", F.col("tp") / (F.col("ap") + EPS))


def batch_metrics(df: DataFrame, by: list[str], pred: str = "pred", label: str = "label", mask: str = "mask") -> DataFrame:
    """accuracy, precision and recall per batch; 0 where a denominator is 0."""
    p, t, m = F.col(pred), F.col(label), F.col(mask)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.groupBy(*by).agg(
        zero(F.count_if(m & (p == t)), F.count_if(m)).alias("accuracy"), zero(F.count_if(m & p & t), F.count_if(m & p)).alias("precision"), zero(F.count_if(m & p & t), F.count_if(m & t)).alias("recall")
    )


def _weighted() -> list[Column]:
    total = F.sum("total")
    return [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("total")), total), F.lit(0.0)).alias(c) for c in ("precision", "recall")] + [total.alias("total")]


def weighted_rollup(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Averages of precision and recall weighted by total for every prefix of ``keys``, and f1 of the averages; "all" marks a rolled-up key."""
    rolled = stats.rollup(*keys).agg(*_weighted(), *(F.grouping(k).alias(f"_{k}") for k in keys))
    named = rolled.select(*(F.when(F.col(f"_{k}") == 1, "all").otherwise(F.col(k)).alias(k) for k in keys), "precision", "recall", "total")
    both = F.col("precision") + F.col("recall")
    return named.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def masked_avg(df: DataFrame, by: list[str], value: str, mask: str = "mask") -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.when(F.col(mask), F.col(value))), F.count_if(mask)).alias("average"))


def error_rates(viol: DataFrame, files: DataFrame) -> DataFrame:
    """Per (model, category) and per model in total: count, files with any, and rates by file, byte and MiB.

    ``viol`` has (model, category, path, n) with rows of 0 for files without; ``files`` (model, path, bytes) are those with results.
    """
    size = files.groupBy("model").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    per_file = viol.groupBy("model", "category", "path").agg(F.sum("n").alias("n"))
    both = per_file.groupingSets([["model", "category"], ["model"]], "model", "category").agg(F.sum("n").alias("errors"), F.countDistinct(F.when(F.col("n") > 0, F.col("path"))).alias("files_with"), F.grouping("category").alias("g"))
    named = both.select("model", F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "errors", "files_with")
    out = named.join(size, "model")
    return out.withColumn("per_file", F.col("errors") / F.col("files")).withColumn("per_byte", F.col("errors") / F.col("bytes")).withColumn("per_mib", F.col("per_byte") * 1024 * 1024)


def fp_fn(df: DataFrame, off: str = "off", base: str = "base") -> DataFrame:
    """Masked false positives and negatives as addresses, with their kind."""
    wrong = df.where(F.col("mask") & (F.col("pred") != F.col("label")))
    return wrong.select("path", F.when(F.col("pred"), "fp").otherwise("fn").alias("kind"), (F.col(off) + F.col(base)).alias("addr"))


def diff(df: DataFrame) -> DataFrame:
    """Masked rows where prediction and label differ: the union of both kinds."""
    return df.where(F.col("mask") & (F.col("label") != F.col("pred"))).select("path", "off")


def intersect(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag) & F.col("mask")).select("path", "off")


def both_of(contents: packed.Contents, one: str, other: str) -> DataFrame:
    """(path, off) inside the mask that two flags share, where the places of the flags follow from a row each."""

    def find(given: dict[str, packed.Arrays]) -> packed.Arrays:
        sets = [np.unique(packed.keys_of(given[name]["path"], given[name]["off"])) for name in (one, other, "mask")]
        keys = np.intersect1d(np.intersect1d(*sets[:2], assume_unique=True), sets[2], assume_unique=True)
        return {"path": keys >> 32, "off": (keys & 0xFFFFFFFF) - (1 << 31)}

    return contents.in_tasks(find, "path string, off int")


def before_after(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-ups of two sets of statistics side by side."""
    a, b = (weighted_rollup(x, keys).select(*keys, *(F.col(c).alias(f"{c}_{name}") for c in ("precision", "recall", "f1"))) for x, name in ((before, "before"), (after, "after")))
    return a.join(b, keys)


def merge_summaries(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        own = df.withColumn("dataset", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out
