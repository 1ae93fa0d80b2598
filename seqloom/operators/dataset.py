"""Building data sets: samples, splits, shuffles, quotas, buckets, epochs, vocabularies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.lineage import materialize


def turn(key: Column, seed: int) -> Column:
    """A seeded order key that other engines can compute too."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(turn(F.col(key), seed), key).limit(n)


def shuffle(df: DataFrame, seed: int, key: str) -> DataFrame:
    return df.orderBy(turn(F.col(key), seed), key)


def ranked(df: DataFrame, group: str, order: list[Column], weight: str | None = None, out: str = "rank") -> DataFrame:
    """``out``: how many rows (or how much ``weight``) come before a row in its group.

    Rows are range-partitioned by group and order, so that a group which holds most rows is ranked by many tasks; sums
    per range and group place the ranges. Null is a group.
    """
    rows = df.repartitionByRange(F.col(group).asc(), *order).withColumn("_range", F.spark_partition_id())
    rows = materialize(rows, "ranges")
    size = F.lit(1) if weight is None else F.col(weight)
    sums = rows.groupBy("_range", F.col(group).alias("_group")).agg(F.sum(size).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_range").alias("_of"), "_group", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(size).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("_within", F.coalesce(within, F.lit(0)))
    met = placed.join(sums, (F.col("_range") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_of", "_group", "_before", "_within")


def shuffled_places(df: DataFrame, seed: int, key: str, group: str) -> DataFrame:
    """``place`` (from 1) of each row in the seeded order of its group."""
    rows = df.withColumn("_turn", turn(F.col(key), seed))
    return ranked(rows, group, [F.col("_turn"), F.col(key)], out="place").withColumn("place", F.col("place") + 1).drop("_turn")


def split(df: DataFrame, key: str, test: float = 0.1, seed: int = 42) -> DataFrame:
    """``part``: test or train, by the row's key alone."""
    share = F.conv(F.substring(turn(F.col(key), seed), 1, 6), 16, 10).cast("long") / F.lit(float(16**6))
    return df.withColumn("part", F.when(share < test, "test").otherwise("train"))


def top_k(df: DataFrame, by: str, k: int, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def epochs(df: DataFrame, e: int, seed: int, key: str) -> DataFrame:
    """``e`` passes over the rows, each with its own seeded place."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(e - 1))))
    place = F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string"), F.lit(f":{seed}")))
    return rows.withColumn("turn", place)


def stratified_take(df: DataFrame, quotas: DataFrame, seed: int, key: str, group: str = "dataset") -> DataFrame:
    """The first n of each group in seeded order; ``quotas`` has (group, n) and is small by its nature.

    The order key's leading digits are counted first, and only the digits that the quota ends in are ranked row by row.
    """
    rows = df.withColumn("_turn", turn(F.col(key), seed)).withColumn("_cell", F.substring("_turn", 1, 3))
    counts = rows.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)))
    state = upto.join(F.broadcast(quotas), group).where(F.col("_upto") - F.col("_n") < F.col("n")).select(group, "_cell", (F.col("n") - F.col("_upto") + F.col("_n")).alias("_room"), "_n")
    near = rows.join(state, [group, "_cell"])
    rank = F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_turn", key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_room")).select(*df.columns)


def bucket_pick(df: DataFrame, size: str, most: int = 3, keep_singletons: bool = False, key: str = "path") -> DataFrame:
    """Up to ``most`` evenly spaced rows of each power-of-two size bucket, largest first; a bucket of one gives none by default."""
    rows = df.where(F.col(size) > 0).withColumn("bucket", F.floor(F.log2(size)).cast("int"))
    counts = F.broadcast(rows.groupBy("bucket").agg(F.count("*").alias("_c")))  # a row per power of two
    placed = ranked(rows, "bucket", [F.desc(size), F.col(key)], out="_r").join(counts, "bucket")
    m = F.least(F.lit(most), F.col("_c"))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: F.floor(i * (F.col("_c") - 1) / F.greatest(F.lit(1), m - 1)))
    kept = F.array_contains(wanted.cast("array<long>"), F.col("_r").cast("long"))
    return placed.where(kept & ((F.col("_c") > 1) | F.lit(keep_singletons))).select(*df.columns, "bucket")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by partial minima."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("x")).select(key, "x.*").select(*df.columns)


def argmax_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, ``order`` and ``value`` of the row with the largest value of each group, the least ``order`` of equal ones; by partial
    minima. Null values come last."""
    best = F.min(F.struct(F.col(value).isNull(), (-F.col(value)).alias("v"), F.col(order))).alias("x")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"x.{order}").alias(order), (-F.col("x.v")).alias(value))


def mix(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def word_counts(df: DataFrame, text: str) -> DataFrame:
    words = df.select(F.explode(F.split(F.trim(text), r"\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def merge_counts(words: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """(a, b, n): neighbouring symbols of all words after ``merges``, weighted by the words' counts."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for word, n in zip(batch["word"], batch["n"], strict=True):
                s = apply_merges(word, merges)
                for p in zip(s, s[1:], strict=False):
                    seen[p] = seen.get(p, 0) + n
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    return words.mapInPandas(pairs, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def apply_merges(word: str, merges: list[tuple[str, str]]) -> list[str]:
    s = list(word)
    for a, b in merges:
        k = 0
        while k < len(s) - 1:
            if s[k] == a and s[k + 1] == b:
                s[k : k + 2] = [a + b]
            k += 1
    return s


def encode(df: DataFrame, text: str, merges: list[tuple[str, str]], vocab: dict[str, int], most: int = 16, pad: int = 0, unknown: int = 1) -> DataFrame:
    """``ids`` cut and padded to ``most``, and ``length`` before padding, by given merges and vocabulary.

    Words end at the six ASCII blanks that ``word_counts`` splits at; other blanks (no-break space, next line) are symbols.
    """
    word = re.compile(r"[^ \t\n\x0B\f\r]+")

    @F.pandas_udf("ids array<int>, length int")
    def of(column: pd.Series) -> pd.DataFrame:
        known: dict[str, list[int]] = {}
        rows = []
        for t in column:
            ids: list[int] = []
            for w in map(re.Match.group, word.finditer(t or "")):
                if w not in known:
                    known[w] = [vocab.get(x, unknown) for x in apply_merges(w, merges)]
                ids += known[w]
                if len(ids) >= most:
                    break
            ids = ids[:most]
            rows.append((ids + [pad] * (most - len(ids)), len(ids)))
        return pd.DataFrame(rows, columns=["ids", "length"])

    return df.withColumn("_e", of(F.col(text))).select(*df.columns, "_e.*")
