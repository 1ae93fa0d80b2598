"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning, overfull ranges cut again.

Law ``bytes``: shards are consecutive runs of the key order with nearly equal sizes, at most about one document apart.
The key is (hash of the text, doc_id), so equal texts stand together and a group of copies that is larger than a range
is cut between documents. Text never shuffles; only (doc_id, size, crc, key) does.

Defined cases: a null text has size 1 and the checksum of no bytes; null doc_ids sort first; repeated rows are kept and
get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.lineage import materialize

NO_ID = -(2**63)
OUT = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "range_id"}


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    data = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("tie"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []),
    )


def draw(rows: DataFrame, count: int, total: int, seed: int) -> list[tuple[int, int]]:
    """About ``count`` keys, each row drawn with a chance in proportion to its size, by a hash so that reruns agree."""
    chance = F.col("size") * F.lit(count / max(1, total))
    u = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(2**40)) / F.lit(float(2**40))
    return sorted((r.key, r.tie) for r in rows.where(u < chance).select("key", "tie").distinct().collect())


def quantiles(sample: list[tuple[int, int]], ranges: int) -> list[tuple[int, int]]:
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if len(sample) >= 2 else []


def range_of(splitters: list[tuple[int, int]]):
    """A vectorised search for the range of (key, tie): how many splitters are at or below it."""
    keys, ties = np.array([k for k, _ in splitters], np.int64), np.array([t for _, t in splitters], np.int64)

    @F.pandas_udf("int")
    def find(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        for a, b in {(a, b) for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True)}:
            own = (lo == a) & (hi == b)
            hi[own] = a + np.searchsorted(ties[a:b], t[own], "right")
        return pd.Series(hi.astype(np.int32))

    return find(F.col("key"), F.col("tie"))


def splitters_of(rows: DataFrame, ranges: int, seed: int, rounds: int = 3) -> tuple[list[tuple[int, int]], list]:
    """Splitters, and per range (id, rows, bytes). Ranges of over twice the mean are sampled anew and cut, a few times."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(ranges, n // 500_000)
    found = quantiles(draw(rows, 16 * ranges, total, seed), ranges)
    for k in range(rounds):
        stats = rows.groupBy(range_of(found).alias("range_id")).agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
        full = [r.range_id for r in stats if r.bytes > 2 * total / ranges and r.rows > 1]
        if not full or k == rounds - 1:
            break
        overfull = rows.where(range_of(found).isin(full))
        more = draw(overfull, 16 * ranges, total, seed + k + 1)
        cut = sorted({*found, *more[8::8]})
        if cut == found:
            break
        found = cut
    return found, sorted(stats)


def shard(docs: DataFrame, shards: int = 8, ranges: int = 256, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, range_id and the columns in ``carry``.

    A carried column that has the name of one of these comes as ``carried_`` and its name.
    """
    spark = docs.sparkSession
    rows = materialize(keyed(docs), "shard-keys")
    found, stats = splitters_of(rows, ranges, seed)
    total = sum(r.bytes for r in stats)
    ahead, at_row, at_byte = [], 0, 0
    for r in stats:
        ahead.append((r.range_id, at_row, at_byte))
        at_row, at_byte = at_row + r.rows, at_byte + r.bytes
    offsets = spark.createDataFrame(ahead, "range_id int, rows_ahead long, bytes_ahead long")
    order = Window.partitionBy("range_id").orderBy("key", "tie", "size", "text_crc32")

    def place(own: DataFrame) -> DataFrame:
        return (
            own.withColumn("range_id", range_of(found))
            .withColumn("nth", F.row_number().over(order))
            .withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .join(F.broadcast(offsets), "range_id")  # a row per range, of which there are max(ranges, rows / 500,000)
            .withColumn("place", F.col("rows_ahead") + F.col("nth") - 1)
            .withColumn("middle", F.col("bytes_ahead") + F.col("upto") - F.col("size") / 2)
            .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(1, total)))).cast("int"))
        )

    starts = place(rows).groupBy("shard").agg(F.min("place").alias("start"))
    # what is carried moves once, here; the order of rows with equal keys does not matter, as they are equal
    placed = place(keyed(docs, carry) if carry else rows)
    return placed.join(F.broadcast(materialize(starts, "shard-starts")), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "range_id",
        *(F.col(f"carried.`{c}`").alias(f"carried_{c}" if c.lower() in OUT else c) for c in carry),
    )
