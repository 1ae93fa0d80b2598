"""Pruning, evaluation and violations of whole files in one call, for any number of models that share a file's tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import packed
from seqloom.operators.metrics import confusion
from seqloom.operators.postdom import KINDS_OF_VIOLATION, judge, judged


def prune_report(truth: DataFrame, scores: DataFrame, pdt: DataFrame, single: bool = False) -> DataFrame:
    """A row per (path, model): rates of what pruning keeps, the number of kept positions and of violations by kind.

    ``truth``: path, off, label, mask, cf; ``scores``: path, model, off, w; ``pdt``: path, wcc, id, ipdom, built once a path and
    used for all of its models. With ``single`` positions outside the mask do not count as kept, and ``fps`` and ``fns`` list
    the false positions in order. A path without a score row for a model has no row; one that keeps nothing has zeros.
    """
    keyed = F.concat_ws("/", F.length("model"), F.concat("model", "path"))
    names = scores.select("path", "model").distinct().withColumn("key", keyed)
    nodes = scores.join(truth.select("path", "off", "cf"), ["path", "off"]).join(names, ["path", "model"])
    trees = pdt.join(names, "path").select(F.col("key").alias("path"), "wcc", "id", "ipdom")
    found = judge(trees, nodes.select(F.col("key").alias("path"), F.col("off").alias("id"), "cf", "w")).withColumnsRenamed({"path": "key", "id": "off"})
    rows = truth.join(names, "path").join(found, ["key", "off"], "left")
    kept = F.coalesce("kept", F.lit(False))
    rows = rows.withColumn("pred", kept & F.col("mask") if single else kept)
    counts = [F.count_if("pred").alias("kept"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS_OF_VIOLATION)]
    if single:
        wrong = lambda c: F.array_sort(F.collect_list(F.when(F.col("mask") & c, F.col("off"))))
        counts += [wrong(F.col("pred") & ~F.col("label")).alias("fps"), wrong(~F.col("pred") & F.col("label")).alias("fns")]
    return confusion(rows, ["path", "model"]).join(rows.groupBy("path", "model").agg(*counts), ["path", "model"])


SINGLE = ", ".join(["path string, kept long", *(f"{k} long" for k in KINDS_OF_VIOLATION), "fps string, fns string"])


def prune_single_of(contents: packed.Contents) -> DataFrame:
    """What ``prune_report`` with ``single`` says of graphs that follow from a row each, whose nodes have label and mask: path, kept,
    violations by kind, and the false positions as texts with commas between."""
    return contents.in_tasks(_single, SINGLE)


def _single(given: dict[str, packed.Arrays]) -> packed.Arrays:
    nodes = packed.Nodes(given["nodes"])
    tree, kept, found = judged(given)
    pred = np.zeros(len(nodes), bool)
    pred[nodes.find(tree.path[kept], tree.id[kept])] = True
    label, mask = nodes.column("label"), nodes.column("mask")
    pred &= mask
    paths, first = np.unique(nodes.path, return_index=True)
    size = int(paths[-1]) + 1 if len(paths) else 0
    count = lambda path: np.bincount(path, minlength=size)[paths]

    def listed(wrong: np.ndarray) -> np.ndarray:
        ends = np.searchsorted(at := np.flatnonzero(wrong), first)
        return np.array([",".join(map(str, ids.tolist())) for ids in np.split(nodes.id[at], ends[1:])][: len(paths)], object)

    out = {"path": paths, "kept": count(nodes.path[pred]), "fps": listed(mask & pred & ~label), "fns": listed(mask & label & ~pred)}
    return out | {kind: count(tree.path[at]) for kind, at in zip(KINDS_OF_VIOLATION, found, strict=True)}
