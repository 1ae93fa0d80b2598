"""Streams: ingest each file once, metrics per micro-batch, results appended as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.matching import pending
from seqloom.operators.metrics import batch_metrics
from seqloom.plans.lineage import discard, materialize
from seqloom.sources.sinks import parted, tried


def ingest_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """All files of a folder that no earlier call with this checkpoint has taken, appended to a parquet table."""
    stream = spark.readStream.schema(schema).parquet(source)
    out = transform(stream) if transform else stream
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_batch(df: DataFrame, sink: str, number: int, key: str = "batch") -> None:
    """Write the rows as partition ``number`` of a parquet table; a replay of the batch replaces what its first run left."""
    df.withColumn(key, F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(sink)


def metrics_per_batch(stream: DataFrame, sink: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Accuracy, precision and recall of each micro-batch (pred, label, mask), each from zero, once each: a batch that runs
    again after a failure replaces its own rows. ``by``: columns that split a batch further."""

    def write(batch: DataFrame, number: int) -> None:
        replace_batch(batch_metrics(batch.withColumn("_all", F.lit(1)), ["_all", *by]).drop("_all"), sink, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(todo: DataFrame, key: str, fn: Callable[[dict], dict], schema: str, folder: str, run: int) -> None:
    """Append ``fn`` of the rows that no earlier run has finished to ``folder``: results, failed rows with their message, and a
    ledger of all keys that are done with, failed ones too.

    The ledger of a run is written last. A run that stopped before it did leaves nothing that counts: with the same number
    it takes the same rows again and replaces what it had written.
    """
    spark = todo.sparkSession
    ledger = read_runs(spark, f"{folder}/ledger", todo.select(key)).where(F.col("run") != run)
    done = materialize(tried(pending(todo, ledger.select(key), [key]), fn, schema), "tried")
    good, bad = parted(done)
    for name, df in (("results", good), ("failed", bad)):
        replace_batch(df, f"{folder}/{name}", run, "run")
    replace_batch(done.select(f"given.{key}").distinct(), f"{folder}/ledger", run, "run")
    discard(done)


def read_runs(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of all runs under ``path`` with their run, none if there is no such table yet."""
    schema = like.withColumn("run", F.lit(0)).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts per key and tumbling window, with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
