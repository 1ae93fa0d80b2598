"""Windows over sequences of any length: rows of one key are cut into blocks that different tasks hold.

Places in the sequence come from range partitions and their sums (``dataset.ranked``). A block takes the rows near its
borders too where a window looks beyond them, and running values are carried from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.dataset import ranked

BLOCK = 50_000  # rows


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with _place, a row's place in the order of its key, from 0."""
    rows = df.withColumn("_key", F.struct(*keys))
    return ranked(rows, "_key", [F.col(c) for c in order], out="_place").drop("_key")


def near(df: DataFrame, keys: list[str], order: list[str], left: int, right: int, columns: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with ``columns``, expressions over a window from ``left`` rows before to ``right`` rows after each row of its key.

    Each expression is given as a function's column without a window, such as ``F.collect_list("x")``.
    """
    rows = placed(df, keys, order).withColumn("_own", F.floor(F.col("_place") / block))
    first, last = F.floor((F.col("_place") - right) / block), F.floor((F.col("_place") + left) / block)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    w = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-left, right)
    out = rows.select("*", *(c.over(w).alias(name) for name, c in columns.items()))
    return out.where("_own = _block").select(*df.columns, *columns)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``out``: the largest value before each row in the order of its key, null at the start."""
    rows = placed(df, keys, order).withColumn("_block", F.floor(F.col("_place") / block))
    most = rows.groupBy(*keys, "_block").agg(F.max(value).alias("_most"))
    before = F.max("_most").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = most.select(F.struct(*keys).alias("_k"), F.col("_block").alias("_b"), before.alias("_carried"))
    inside = F.max(value).over(Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("_inside", inside).join(carried, (F.col("_block") == F.col("_b")) & F.struct(*keys).eqNullSafe(F.col("_k")))
    return met.select(*df.columns, F.greatest("_carried", "_inside").alias(out))
