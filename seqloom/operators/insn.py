"""Superset instruction tables: windows, opcode keys, flow kinds, successors, the census."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.tables import explode_positions

# fixed values: kind numbers and the rule table (opcode from, to, opcode length, what of modrm, its value, kind)
KINDS = ("unknown", "other", "call", "return", "jump", "cond", "far_call", "far_return", "far_jump", "halt", "indirect")
RULES = [
    (0x70, 0x7F, 1, None, None, 5),
    (0x80, 0x8F, 2, None, None, 5),
    (0xE0, 0xE3, 1, None, None, 5),
    (0xF4, 0xF4, 1, None, None, 9),
    (0x0B, 0x0B, 2, None, None, 9),
    (0x9A, 0x9A, 1, None, None, 6),
    (0xCC, 0xCE, 1, None, None, 6),
    (0xF1, 0xF1, 1, None, None, 6),
    (0x05, 0x05, 2, None, None, 6),
    (0x34, 0x34, 2, None, None, 6),
    (0x01, 0x01, 2, "modrm", 0xC1, 6),
    (0xE8, 0xE8, 1, None, None, 2),
    (0xE9, 0xE9, 1, None, None, 4),
    (0xEB, 0xEB, 1, None, None, 4),
    (0xEA, 0xEA, 1, None, None, 8),
    (0xC2, 0xC3, 1, None, None, 3),
    (0xCA, 0xCB, 1, None, None, 7),
    (0xCF, 0xCF, 1, None, None, 7),
    (0x07, 0x07, 2, None, None, 7),
    (0x35, 0x35, 2, None, None, 7),
    (0x01, 0x01, 2, "modrm", 0xC2, 7),
    (0x01, 0x01, 2, "modrm", 0xC3, 7),
    (0xFF, 0xFF, 1, "reg", 2, 2),
    (0xFF, 0xFF, 1, "reg", 3, 6),
    (0xFF, 0xFF, 1, "reg", 4, 4),
    (0xFF, 0xFF, 1, "reg", 5, 8),
]
RULE_SCHEMA = "lo int, hi int, oplen int, field string, want int, kind int"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_SCHEMA)


def with_rules(df: DataFrame) -> DataFrame:
    """``kind`` of rows (opcode, opcode_len, modrm) by a broadcast lookup in the rule table, whose size is fixed; no rule is other."""
    table = rules(df.sparkSession).select(F.explode(F.sequence("lo", "hi")).alias("opcode"), F.col("oplen").alias("opcode_len"), "field", "want", "kind")
    by_op = table.groupBy("opcode", "opcode_len").agg(F.collect_list(F.struct("field", "want", "kind")).alias("rules"))
    met = df.join(F.broadcast(by_op), ["opcode", "opcode_len"], "left")
    reg = F.shiftright("modrm", 3).bitwiseAND(7)
    hit = F.filter("rules", lambda r: r["field"].isNull() | ((r["field"] == "modrm") & (r["want"] == F.col("modrm"))) | ((r["field"] == "reg") & (r["want"] == reg)))
    return met.withColumn("kind", F.when(F.col("opcode").isNull(), 0).otherwise(F.coalesce(F.get(hit, F.lit(0))["kind"], F.lit(1)))).drop("rules")


def kgram_windows(df: DataFrame, content: str, k: int = 15, pad: int = 0x90, tokens: bool = False, at: str | None = "off") -> DataFrame:
    """``window`` of k byte values of ``content`` from column ``at`` on (None: from its start); as tokens, the i-th value has 256 * i added."""
    first = F.lit(0) if at is None else F.col(at)
    values = F.transform(F.sequence(first + 1, first + k), lambda i: F.coalesce(F.conv(F.nullif(F.hex(F.substring(F.col(content), i.cast("int"), F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(pad)))
    return df.withColumn("window", F.transform(values, lambda x, i: x + 256 * i) if tokens else values)


PREFIX = "(?:26|2E|36|3E|64|65|66|67|F0|F2|F3{rex})"


def opcode_key(df: DataFrame, window: str = "hex", is64: str = "is64") -> DataFrame:
    """opcode, opcode_len and modrm of a window in upper-case hex; all null if it holds nothing but prefixes.

    Prefixes go first (REX in 64-bit code only). VEX and EVEX carry the map in their own bytes; the escapes 0F, 0F38,
    0F3A and 0F0F give the length. Bytes behind the window read as zero.
    """
    w, x64 = F.col(window), F.col(is64)
    rest = F.when(x64, F.regexp_replace(w, "^" + PREFIX.format(rex="|4[0-9A-F]") + "+", "")).otherwise(F.regexp_replace(w, "^" + PREFIX.format(rex="") + "+", ""))
    df = df.withColumn("_rest", rest)
    r = F.col("_rest")

    def byte(k: int) -> Column:
        return F.coalesce(F.conv(F.nullif(F.substring(r, 2 * k + 1, 2), F.lit("")), 16, 10).cast("int"), F.lit(0))

    b0, b1, b2 = byte(0), byte(1), byte(2)
    vector = x64 | (b1.bitwiseAND(0xC0) == 0xC0)

    def key(opcode: Column, size: Column, modrm: Column) -> Column:
        return F.struct(opcode.alias("opcode"), size.cast("int").alias("opcode_len"), modrm.alias("modrm"))

    out = (
        F.when(F.length(r) < 2, F.lit(None).cast("struct<opcode:int,opcode_len:int,modrm:int>"))
        .when((b0 == 0xC5) & vector, key(b2, F.lit(2), byte(3)))
        .when((b0 == 0xC4) & vector, key(byte(3), b1.bitwiseAND(0x1F), byte(4)))
        .when((b0 == 0x62) & vector, key(byte(4), b1.bitwiseAND(0x03), byte(5)))
        .when(b0 != 0x0F, key(b0, F.lit(1), b1))
        .when(b1.isin(0x38, 0x3A), key(b2, F.lit(3), byte(3)))
        .when(b1.bitwiseAND(0xF8) == 0x38, key(b2, F.lit(0), byte(3)))
        .when(b1 == 0x0F, key(b1, F.lit(3), b2))
        .otherwise(key(b1, F.lit(2), b2))
    )
    return df.withColumn("_key", out).select(*[c for c in df.columns if c != "_rest"], "_key.*")


_PREFIXES = np.zeros(256, bool)
_PREFIXES[[0x26, 0x2E, 0x36, 0x3E, 0x64, 0x65, 0x66, 0x67, 0xF0, 0xF2, 0xF3]] = True


def _opcode_keys(off: np.ndarray, byte: np.ndarray, is64: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    """``opcode_key`` of the bytes from each place on, in arrays."""
    whole, at, size = near
    x64 = is64 == True  # noqa: E712 (a missing flag is none)
    place = np.arange(len(whole))

    def first_other(prefix: np.ndarray) -> np.ndarray:
        """Where the first byte from each place on is that is no prefix."""
        return np.minimum.accumulate(np.where(prefix[whole], len(whole), place)[::-1])[::-1]

    with_rex = _PREFIXES.copy()
    with_rex[0x40:0x50] = True
    start = np.where(x64, first_other(with_rex)[at], first_other(_PREFIXES)[at])
    left = size - (start - at)
    b = [np.where(left > k, whole[np.minimum(start + k, len(whole) - 1)], 0).astype(np.int64) for k in range(6)]
    vector = x64 | (b[1] & 0xC0 == 0xC0)
    cases = [
        ((b[0] == 0xC5) & vector, b[2], 2, b[3]),
        ((b[0] == 0xC4) & vector, b[3], b[1] & 0x1F, b[4]),
        ((b[0] == 0x62) & vector, b[4], b[1] & 0x03, b[5]),
        (b[0] != 0x0F, b[0], 1, b[1]),
        ((b[1] == 0x38) | (b[1] == 0x3A), b[2], 3, b[3]),
        (b[1] & 0xF8 == 0x38, b[2], 0, b[3]),
        (b[1] == 0x0F, b[1], 3, b[2]),
    ]
    when = [c[0] for c in cases]
    none = left < 1
    found = [np.select(when, [np.broadcast_to(c[k], b[0].shape) for c in cases], other) for k, other in ((1, b[1]), (2, 2), (3, b[2]))]
    return {name: (x, none) for name, x in zip(("opcode", "opcode_len", "modrm"), found, strict=True)}


def derive_successors(insn: DataFrame, mode: str = "static") -> DataFrame:
    """must, may, next and succ of rows (kind, off, len, target, n).

    Ordinary instructions fall through; conditional jumps may also go to their target; jumps go to it; calls, returns,
    far transfers and halts have no successor, though a call's ``must`` is the next instruction. Targets outside [0, n)
    are null; a jump without a target is indirect (kind 10). With ``mode='imm'``, ``must`` of calls and jumps is
    the target where there is one, and of ordinary instructions the next one.
    """
    nx = F.col("off") + F.col("len")
    inside = lambda c: F.when((c >= 0) & (c < F.col("n")), c)
    falls, target, kind = inside(nx), inside(F.col("target")), F.col("kind")
    goes = F.when(kind.isin(4, 5), target)
    step = F.when((F.col("len") > 0) & kind.isin(0, 1, 5), falls)
    if mode == "imm":
        must = F.when((kind == 1) & (F.col("len") > 0), falls).when(kind.isin(2, 4), target)
    else:
        must = F.when(kind == 2, falls).when(kind == 4, target)
    return insn.withColumns(
        {
            "must": must.cast("int"),
            "may": F.when(kind == 5, F.array_compact(F.array(falls, target))),
            "next": F.when(F.col("len") > 0, falls).cast("int"),
            "succ": F.array_distinct(F.array_compact(F.array(step, goes))),
            "kind": F.when((kind == 4) & F.col("target").isNull(), 10).otherwise(kind),
        }
    )


def superset(corpus: DataFrame, content: str = "content", decoder: Callable | None = None, schema: str | None = None) -> DataFrame:
    """One row per byte of (path, is64, content): off, byte, hex window of 15, opcode key and flow kind.

    ``decoder`` (a mapInPandas function over these rows, with its ``schema``) can add lengths and targets.
    """
    rows = explode_positions(corpus, content, ("path", "is64"), ahead=15, decode=_opcode_keys, schema="opcode int, opcode_len int, modrm int")
    out = rows.select("path", "is64", "off", "byte", F.hex("window").alias("hex"), "opcode", "opcode_len", "modrm")
    out = with_rules(out)
    return out.mapInPandas(decoder, schema) if decoder else out


def opcode_counts(corpus: DataFrame, content: str = "content") -> DataFrame:
    """(path, opcode, opcode_len, modrm, n): how often each byte value occurs in a row's content, counted without a row per byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.zeros((batch.num_rows, 256), np.int64)
            for k, body in enumerate(batch.column(1).to_pylist()):
                table[k] = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
            row, opcode = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(opcode, pa.int32()), pa.array(table[row, opcode])], names=["path", "opcode", "n"])

    found = corpus.where(F.col(content).isNotNull()).select("path", content).mapInArrow(count, "path string, opcode int, n long")
    return found.select("path", "opcode", F.lit(1).alias("opcode_len"), F.lit(0).alias("modrm"), "n")


def flow_census(kinds: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows (or the sum of ``weight``) per (path, kind), per kind over the corpus, and in all, by ROLLUP: level 0, 1 and 2 as ``level``."""
    return kinds.rollup("kind", "path").agg((F.sum(weight) if weight else F.count("*")).alias("rows"), F.grouping_id().alias("gid")).select("kind", "path", "rows", F.when(F.col("gid") == 0, 0).when(F.col("gid") == 1, 1).otherwise(2).alias("level"))


def flow_ratio(insn: DataFrame) -> DataFrame:
    """Per path: indirect jumps on labelled offsets, labelled offsets, and their ratio; zeros where none is labelled."""
    counts = insn.groupBy("path").agg(F.count_if(F.col("label") & (F.col("kind") == 10)).alias("indirect"), F.count_if("label").alias("labelled"))
    return counts.withColumn("ratio", F.coalesce(F.try_divide("indirect", "labelled"), F.lit(0.0)))
