"""Joins of predictions, truth, side files and finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_pred(gt: DataFrame, pred: DataFrame, fallback: Column, key: str = "path", value: str = "value") -> DataFrame:
    """Truth with the prediction of its path, or else of its fallback key; rows without either are dropped."""
    one = pred.select(F.col(key).alias("_k1"), F.col(value).alias("_v1"))
    two = pred.select(F.col(key).alias("_k2"), F.col(value).alias("_v2"))
    met = gt.withColumn("_f", fallback).join(one, F.col(key) == F.col("_k1"), "left").join(two, F.col("_f") == F.col("_k2"), "left")
    return met.withColumn(value, F.coalesce("_v1", "_v2")).where(F.col("_k1").isNotNull() | F.col("_k2").isNotNull()).select(*gt.columns, value)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def all_present(wanted: DataFrame, have: DataFrame, keys: list[str]) -> bool:
    return pending(wanted, have, keys).isEmpty()


def attach_sidecar(df: DataFrame, side: DataFrame, rule: Column, side_key: str) -> DataFrame:
    """Rows with the side file that a rule derives from their path; without one they are skipped."""
    return df.withColumn("_side", rule).join(side, F.col("_side") == F.col(side_key)).drop("_side")
