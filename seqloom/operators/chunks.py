"""Overlapping chunks of sequences, batches of them, scoring, and stitching back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNKS = 4096  # chunks that a task hands over together


def chunk(df: DataFrame, values: str, size: int, left: int = 0, right: int = 0, keys: tuple[str, ...] = ("path",), label_mask: str | None = None, compat: bool = False) -> DataFrame:
    """Chunks of ``size`` values, a step of size - left - right apart: keys, chunk, start, values, mask.

    Values are padded with 0; the mask is false on padding, on the last ``right`` positions, and on the first ``left``
    positions of all chunks but the first, so every offset is valid in exactly one chunk. With ``compat`` the left part is
    masked only where right > 0, and offsets repeat. With right = 0 and left = 0 chunks do not overlap.
    """
    step = size - left - right
    if size <= 0 or step <= 0:
        raise ValueError("size and size - left - right must be positive")
    kinds = dict(df.dtypes)
    free_left = left if (right > 0 or not compat) else 0
    inner = np.arange(size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield from some(batch.slice(k, 64))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, n, flat = _flat(batch.column(len(keys)), 0)
        count = -(-n // step)
        row, number = np.repeat(np.arange(len(n)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for k in range(0, len(row), CHUNKS):
            own, chunk = row[k : k + CHUNKS], number[k : k + CHUNKS]
            at = chunk[:, None] * step + inner
            inside = at < n[own][:, None]
            valid = inside & (inner < size - right) & ((chunk[:, None] == 0) | (inner >= free_left))
            mask, unknown = pa.array(valid.ravel()), None
            if label_mask:
                labels = batch.column(len(keys) + 1)
                l_first, l_n, l_flat = _flat(labels, False)
                held = l_flat.take(pa.array(np.where(at < l_n[own][:, None], l_first[own][:, None] + at, len(l_flat) - 1).ravel()))
                mask, unknown = pa.compute.and_kleene(mask, held), labels.is_null().take(pa.array(own))
            taken = flat.take(pa.array(np.where(inside, first[own][:, None] + at, len(flat) - 1).ravel()))
            ends = pa.array(np.arange(0, len(own) * size + 1, size, dtype=np.int32))
            lists = pa.ListArray.from_arrays(ends, taken), pa.ListArray.from_arrays(ends, mask, mask=unknown)
            columns = [c.take(pa.array(own)) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chunk.astype(np.int32)), pa.array((chunk * step).astype(np.int32)), *lists], names=[*keys, "chunk", "start", "values", "mask"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["chunk int", "start int", f"values {kinds[values]}", "mask array<boolean>"])
    return df.where(F.size(values) > 0).select(*keys, values, *([label_mask] if label_mask else [])).mapInArrow(cut, schema)


def _flat(lists: pa.Array, pad) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each list starts, its length, the values of all lists and a pad behind them)."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    return np.cumsum(n) - n, n, pa.concat_arrays([flat, pa.array([pad]).cast(flat.type)])


def stitch(chunks: DataFrame, value: str = "values", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Long form: keys, off, value of the valid positions of chunks."""
    at = F.arrays_zip(F.col(value).alias("value"), F.col("mask").alias("mask"))
    rows = chunks.select(*keys, "start", F.posexplode(at).alias("pos", "x"))
    return rows.where("x.mask").select(*keys, (F.col("start") + F.col("pos")).alias("off"), F.col("x.value").alias("value"))


def stitch_arrays(chunks: DataFrame, value: str = "values", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """One array per sequence, in offset order; a sequence fits a row as it did before it was cut."""
    rows = stitch(chunks, value, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("x"))
    return rows.select(*keys, F.transform("x", lambda r: r["value"]).alias("values"))


def batchify(chunks: DataFrame, batch: int, keys: tuple[str, ...] = ("path",), pad: int = 0x90) -> DataFrame:
    """Batches of exactly ``batch`` chunks per sequence: keys, batch, values and mask as arrays of arrays, the last one padded."""
    own = list(keys)
    placed = chunks.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*own).orderBy("chunk")) - 1) / batch).cast("int"))
    rows = placed.groupBy(*own, "batch").agg(F.array_sort(F.collect_list(F.struct("chunk", "values", "mask"))).alias("x"))
    size = F.size(F.get(F.col("x"), F.lit(0))["values"])
    return rows.select(
        *own,
        "batch",
        F.size("x").alias("filled"),
        F.slice(F.concat(F.transform("x", lambda r: r["values"]), F.array_repeat(F.array_repeat(F.lit(pad), size), batch)), 1, batch).alias("values"),
        F.slice(F.concat(F.transform("x", lambda r: r["mask"]), F.array_repeat(F.array_repeat(F.lit(False), size), batch)), 1, batch).alias("mask"),
    )


def score_chunks(chunks: DataFrame, predict: Callable[[list], list], keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """``scores`` of every chunk by a caller's function of a list of value arrays, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*keys, "chunk", "start", "mask"]].copy()
            out["scores"] = predict([list(v) for v in batch["values"]])
            yield out

    kinds = dict(chunks.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*keys, "chunk", "start", "mask")] + ["scores array<double>"])
    return chunks.mapInPandas(run, schema)
