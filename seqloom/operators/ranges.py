"""Ranges over offsets: clipping, painting, overlaps, runs, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import sequence


def rebase(df: DataFrame, addr: str = "addr", base: str = "base", size: str = "n") -> DataFrame:
    """Rows whose address lies in the section, with its offset there."""
    return df.where((F.col(addr) >= F.col(base)) & (F.col(addr) < F.col(base) + F.col(size))).withColumn("off", F.col(addr) - F.col(base))


def clip_ranges(df: DataFrame, size: str = "n", mode: str = "clip") -> DataFrame:
    """Ranges (start, end) against [0, n): cut to it, or only those ``inside`` it, or only those that ``start`` in it."""
    n = F.col(size)
    if mode == "clip":
        out = df.withColumn("start", F.greatest(F.lit(0), F.col("start"))).withColumn("end", F.least(n, F.col("end")))
    else:
        inside = (F.col("start") >= 0) & (F.col("start") < n)
        out = df.where(inside & (F.col("end") <= n) if mode == "inside" else inside)
    return out.where("start < end")


def paint(positions: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("path",), bin_size: int = 64) -> DataFrame:
    """Positions inside ranges, with the order and kind of the last range that covers each."""
    own = list(keys)

    def last(k):
        return F.array_max(F.transform(F.filter("_pieces", lambda x: (x["a"] <= k) & (k < x["b"])), lambda x: F.struct(x["ord"].alias("ord"), x["kind"].alias("kind"))))

    # bins are resolved to an entry per offset before positions meet them, each once
    cells = _binned(ranges, own, bin_size).select(*own, "bin", F.transform(F.sequence(F.lit(0), F.lit(bin_size - 1)), last).alias("_last"))
    at = positions.select(*own, "off", F.floor(F.col("off") / bin_size).alias("bin"))
    met = at.join(cells, [*own, "bin"]).select(*own, "off", F.get("_last", F.pmod(F.col("off"), F.lit(bin_size)).cast("int")).alias("last"))
    return met.where("last is not null").select(*own, "off", F.col("last.ord").alias("last_ord"), F.col("last.kind").alias("last_kind"))


def _binned(ranges: DataFrame, own: list[str], bin_size: int) -> DataFrame:
    """(keys, bin, _pieces): ranges laid into bins of ``bin_size`` offsets and cut to them.

    Of equal pieces of a kind the last one counts, so a bin holds a bounded number of them, however many ranges cover it.
    """
    binned = ranges.where("start < end").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    low = F.col("bin") * bin_size
    pieces = binned.groupBy(*own, "bin", F.greatest(F.col("start") - low, F.lit(0)).cast("int").alias("a"), F.least(F.col("end") - low, F.lit(bin_size)).cast("int").alias("b"), "kind").agg(F.max("ord").alias("ord"))
    return pieces.groupBy(*own, "bin").agg(F.collect_list(F.struct("ord", "kind", "a", "b")).alias("_pieces"))


BITS = 64  # of a number


def paint_masks(positions: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("path",), bin_size: int = BITS) -> DataFrame:
    """mask and data flag of every position: a sets the mask, i clears it, d sets it; the flag is the last of a and d.

    ``positions`` has an offset a row (off), or a span of them (start, end), which becomes rows only after it has met the ranges.
    The pieces of a bin are folded in their order into two numbers with a bit for each of its offsets, at most ``BITS``; i changes only the mask.
    """
    own, size = list(keys), min(bin_size, BITS)

    none = "named_struct('mask', 0L, 'data', 0L)"
    covered = f"(shiftleft(-1L, x.a) & if(x.b < {BITS}, ~shiftleft(-1L, x.b), -1L))"
    step = f"""named_struct('mask', if(x.kind in ('a', 'd'), s.mask | {covered}, s.mask & ~{covered}),
        'data', if(x.kind = 'd', s.data | {covered}, if(x.kind <> 'i', s.data & ~{covered}, s.data)))"""
    cells = _binned(ranges, own, size).select(*own, "bin", F.expr(f"aggregate(array_sort(_pieces), {none}, (s, x) -> {step})").alias("_set"))
    bin_of = lambda c: F.floor(F.col(c) / size)
    spans = "off" not in positions.columns
    if spans:
        at = positions.where("start < end").select(*own, "start", "end", F.explode(F.sequence(bin_of("start"), F.floor((F.col("end") - 1) / size))).alias("bin"))
    else:
        at = positions.select(*own, "off", bin_of("off").alias("bin"))
    met = at.join(cells.hint("shuffle_hash"), [*own, "bin"], "left").withColumn("_low", F.col("bin") * size)
    if spans:
        kind = positions.schema["start"].dataType
        met = met.select(*own, "_low", "_set", F.explode(F.sequence(F.greatest("start", "_low").cast(kind), (F.least("end", F.col("_low") + size) - 1).cast(kind))).alias("off"))
    shown = lambda name: F.coalesce(F.expr(f"shiftright(_set.{name}, cast(off - _low as int)) & 1L") == 1, F.lit(False)).alias(name)
    return met.select(*own, "off", shown("mask"), shown("data"))


def overlaps(insn: DataFrame, side: str = "after", self_too: bool = False, most: int = 15, size: str | None = None) -> DataFrame:
    """(path, off, other): starts inside each instruction (after), or instructions that reach over each (before).

    The pairs are exploded from lengths, at most ``most`` - 1 of each, and need no join but for the bound of the file; none
    where the column ``size`` has it, the offset that no instruction reaches.
    """
    first = 0 if self_too else 1
    reach = F.least(F.col("len"), F.lit(most)) - 1
    if size:
        reach = F.least(reach, F.col(size) - 1 - F.col("off"))
    pairs = insn.where(reach >= first).select("path", F.col("off").alias("a"), F.explode(F.sequence(F.lit(first), reach)).alias("d")).select("path", "a", (F.col("a") + F.col("d")).alias("b"))
    if not size:
        # by a merge of sorted rows: a row per file is no bounded table to broadcast
        ends = insn.groupBy("path").agg(F.max("off").alias("last"))
        pairs = pairs.join(ends.hint("merge"), "path").where("b <= last").drop("last")
    return pairs.select("path", *((F.col("a").alias("off"), F.col("b").alias("other")) if side == "after" else (F.col("b").alias("off"), F.col("a").alias("other"))))


def optional_ranges(insn: DataFrame, key: str = "path", order: tuple[str, ...] = ("off",), at: str = "off", optional: str = "optional", block: int = sequence.BLOCK) -> DataFrame:
    """[last optional offset, next offset) of each run of optional rows; a run at the end gives nothing."""
    here = insn.select(key, *dict.fromkeys([*order, at, optional]))
    seen = sequence.near(here, [key], list(order), 0, 1, {"_near": F.collect_list(F.struct(F.col(at).alias("at"), F.col(optional).alias("optional")))}, block)
    after = F.get("_near", F.lit(1))
    return seen.where(F.col(optional) & ~after["optional"]).select(key, F.col(at).alias("start"), after["at"].alias("end"))


def last_write(df: DataFrame, keys: tuple[str, ...] = ("path", "off"), value: str = "kind", order: str = "ord") -> DataFrame:
    """The value that the last row in the order wrote at each position."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def code_extent(df: DataFrame, key: str = "path", start: str = "start", end: str = "end") -> DataFrame:
    return df.groupBy(key).agg(F.min(start).alias("start"), F.max(end).alias("end"))


def distinct_sorted(df: DataFrame, key: str = "path", addr: str = "addr") -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_set(addr)).alias("addrs"))
