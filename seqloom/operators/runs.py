"""Analytics of benchmark runs: summaries, trends, histograms, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.dataset import ranked


def runtime_summary(bench: DataFrame, tool: str = "tool", runtime: str = "runtime") -> DataFrame:
    """Per tool: runs, success rate in percent, errors, mean, median, min and max of the runtimes; null is an error."""
    r = F.col(runtime)
    out = bench.groupBy(tool).agg(
        F.count("*").alias("runs"),
        (F.count(r) * 100.0 / F.count("*")).alias("success_pct"),
        (F.count("*") - F.count(r)).alias("errors"),
        F.avg(r).alias("mean"),
        F.min(r).alias("min"),
        F.max(r).alias("max"),
    )
    # the median from counts of values, ranked over ranges: a tool's values need not meet in one task
    values = bench.where(r.isNotNull()).groupBy(tool, runtime).agg(F.count("*").alias("_n"))
    sizes = out.select(F.col(tool).alias("_tool"), (F.col("runs") - F.col("errors")).alias("_all"))
    placed = ranked(values, tool, [r.asc()], "_n", "_rank").join(sizes, F.col(tool).eqNullSafe(F.col("_tool")))
    holds = lambda k: (F.col("_rank") <= k) & (k < F.col("_rank") + F.col("_n"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = placed.groupBy("_tool").agg(((F.max(F.when(holds(low), r)) + F.max(F.when(holds(high), r))) / 2).alias("median"))
    return out.join(middle, out[tool].eqNullSafe(middle["_tool"]), "left").select(tool, "runs", "success_pct", "errors", "mean", "median", "min", "max")


def run_stats(runs: DataFrame, group: str, run: str, seconds: str, size: str) -> DataFrame:
    """Means per run, then mean and population deviation over runs, and guarded rates."""
    per = runs.groupBy(group, run).agg(F.avg(seconds).alias("mean_s"), F.sum(seconds).alias("sum_s"), F.sum(size).alias("bytes"), F.count("*").alias("files"))
    return per.groupBy(group).agg(
        F.avg("mean_s").alias("mean_s"),
        F.stddev_pop("mean_s").alias("std_s"),
        F.coalesce(F.try_divide(F.sum("bytes"), F.sum("sum_s")), F.lit(0.0)).alias("bytes_per_s"),
        F.coalesce(F.try_divide(F.sum("files"), F.sum("sum_s")), F.lit(0.0)).alias("files_per_s"),
    )


def trend(df: DataFrame, x: str, y: str, by: list[str], log: bool = False, least: int = 4) -> DataFrame:
    """Least squares line of y over x, or of their decimal logarithms over positive points; null below ``least`` points."""
    if log:
        df = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_x", F.log10(x)).withColumn("_y", F.log10(y))
    else:
        df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double"))
    enough = F.count("*") >= least
    return df.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.when(enough, F.regr_slope("_y", "_x")).alias("slope"),
        F.when(enough, F.regr_intercept("_y", "_x")).alias("intercept"),
        F.when(enough, F.corr("_y", "_x")).alias("r"),
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins from the least to the largest value, which is in the last bin; empty bins are left out."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    placed = df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(ends))  # one row of bounds
    width = (F.col("hi") - F.col("lo")) / bins
    own = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("lo")) / width)))
    return placed.groupBy(own.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pivot_tools(bench: DataFrame, binary: str = "binary", tool: str = "tool") -> DataFrame:
    """Per binary a map of runtimes and a map of errors by tool; of repeats the smallest."""
    one = bench.groupBy(binary, tool).agg(F.min("runtime").alias("runtime"), F.min("error").alias("error"))
    return one.groupBy(binary).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(tool, "runtime")))).alias("runtimes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(tool, "error"))))).alias("errors"),
    )


def split_cached(items: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``hit`` of every item: a cached row with the same key and an equal fingerprint, whose error is empty or final.

    ``items`` have key and hash; ``cache`` key, binary_hash, runtime, error, one row a key.
    """
    final = F.col("error").isNull() | (F.col("error") == "") | F.lower("error").contains("timeout") | F.lower("error").contains("failed")
    met = items.join(cache, key, "left")
    return met.withColumn("hit", F.coalesce((F.col("hash") == F.col("binary_hash")) & final, F.lit(False)))


def cache_stats(checked: DataFrame) -> DataFrame:
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    return checked.agg(
        F.count_if("hit").alias("hits"),
        F.coalesce(F.try_divide(F.count_if("hit") * 100.0, F.count("*")), F.lit(0.0)).alias("hit_pct"),
        F.count_if(F.col("hit") & ~bad).alias("cached_ok"),
        F.count_if(F.col("hit") & bad).alias("cached_error"),
        F.count_if(~F.col("hit")).alias("new"),
    )
