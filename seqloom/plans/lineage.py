"""Reading the given tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold fewer rows than Spark's default of 10,000, since rows here carry whole texts or sets.

    A smaller number that the session has set itself stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def on_one_machine(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's own process (``local-cluster`` has executors of its own)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none (tests), a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are materialized inside, but for kept ones, are deleted at the end. Write or keep the result before."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def materialize(df: DataFrame, name: str = "cut", keep: bool = False, most: int = 0) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back. ``keep``: it outlives the scope that it is in;
    ``most``: rows in a file, if they are long.

    Later steps read the files, so a lost executor costs only its running tasks, and loops keep short plans.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_stored", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 1000) -> DataFrame:
    """(node, component) of every node of an undirected edge list; the component is its smallest node.

    Alternates large-star and small-star steps, each of which keeps the connectivity and pulls edges to local minima;
    the edge list never grows and a logarithmic number of rounds is usual. It ends when every node has one edge, to a node
    that has none up. Stars make hot keys on one side of a join only, where adaptive execution splits them.
    """
    state = materialize(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct(), "edges")
    for _ in range(rounds):
        # stars of one centre each: every v has one edge, and no centre is a v
        shape = state.select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select("m", F.lit(0), F.lit(1)))
        if shape.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up = 1 and down > 0)").isEmpty():
            break
        both = state.union(state.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = both.join(least, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.union(least.where("low < v").select("v", F.col("low").alias("m"))).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        new = materialize(small.union(low.select("v", F.col("low").alias("m"))).where("v <> m").distinct(), "edges")
        discard(state)
        state = new
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    found = state.select(F.col("v").alias("node"), F.col("m").alias("component"))
    out = found.union(state.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
    out._stored = state._stored
    return out
