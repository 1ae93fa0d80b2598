"""Writing corpora, results, summaries and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def pack_corpus(files: DataFrame, path: str, batch_size: int) -> None:
    """Small files as parquet shards of at most ``batch_size`` rows."""
    files.write.mode("overwrite").option("maxRecordsPerFile", batch_size).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset", "model").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A summary, small by its nature, as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def report_line(kind: Column, path: Column, addr: Column, detail: Column) -> Column:
    return F.format_string("%s %s 0x%s[%s]", kind, path, F.lower(F.hex(addr)), detail)


def write_report(violations: DataFrame, path: str) -> None:
    """A text line per violation and footer counts by kind."""
    lines = violations.select(report_line(F.col("kind"), F.col("path"), F.col("addr"), F.col("off").cast("string")).alias("value"))
    footer = violations.groupBy("kind").count().select(F.format_string("# %s: %d", "kind", "count").alias("value"))
    lines.unionByName(footer).write.mode("overwrite").text(path)


def tried(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """(done, given, error): what ``fn`` makes of each row, the row itself, and the message where it fails. No row stops the job."""
    made = T._parse_datatype_string(schema)
    out = T.StructType([T.StructField("done", made), T.StructField("given", df.schema), T.StructField("error", T.StringType())])
    own, arrow = made.fieldNames(), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    got = fn(row)
                    rows.append({"done": {c: got[c] for c in own}, "given": row, "error": None})
                except Exception as e:  # noqa: BLE001  the message goes to the dead letters
                    rows.append({"done": None, "given": row, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out)


def with_dead_letter(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """(results of ``fn`` per row, failed rows with their message). Each of the two runs ``fn`` where the other has not been
    written: ``tried``, materialized, serves both."""
    return parted(tried(df, fn, schema))


def parted(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    return done.where("error is null").select("done.*"), done.where("error is not null").select("given.*", "error")
