"""Reading corpora, labels and ranges into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: first bytes of executable formats, as hex
ELF, MACH_O, PE = "7F454C46", "CFFAEDFE", "4D5A9000"


def magic_of(content: Column) -> Column:
    """The executable format of a file's bytes, or null. ELF counts only as an executable or a shared object."""
    head = F.hex(F.substring(content, 1, 4))
    e_type = F.conv(F.concat(F.hex(F.substring(content, 18, 1)), F.hex(F.substring(content, 17, 1))), 16, 10).cast("int")
    return F.when((head == ELF) & e_type.isin(2, 3), "ELF").when(head == MACH_O, "MachO").when(head == PE, "PE")


def scan_by_magic(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, format) of the executables below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", magic_of(F.col("content")).alias("format")).where("format is not null")


def select_files(df: DataFrame, path: str = "path", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Rows whose path matches ``include`` and not ``exclude``, both regular expressions."""
    kept = F.lit(True)
    if include:
        kept &= F.col(path).rlike(include)
    if exclude:
        kept &= ~F.col(path).rlike(exclude)
    return df.where(kept)


def hex_value(text: Column) -> Column:
    """An address written in hex, with or without 0x, as a decimal that holds 64 unsigned bits."""
    return F.conv(F.regexp_replace(F.trim(text), "^0[xX]", ""), 16, 10).cast("decimal(20,0)")


def read_hex_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, addr) of text files with one hex address a line; other lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    return lines.where(F.col("value").rlike("^(0[xX])?[0-9a-fA-F]+$")).select("path", hex_value(F.col("value")).alias("addr"))


GT = {"path": "string", "off": "int", "label": "boolean", "mask": "boolean"}


def read_gt(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Ground-truth or prediction records, a row per position, of parquet files: the named columns, with null for a flag that is not set."""
    wanted = columns or GT
    found = spark.read.parquet(path)
    have = {c.lower() for c in found.columns}
    return found.select(*((F.col(c) if c.lower() in have else F.lit(None)).cast(kind).alias(c) for c, kind in wanted.items()))


RANGE = r"^\s*0x([0-9a-fA-F]+)-0x([0-9a-fA-F]+)(?:\s+\$([aid]))?\s*$"


def parse_ranges(lines: DataFrame, section: DataFrame, line: str = "line", keys: tuple[str, ...] = ("path",)) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) ranges of lines ``0xS-0xE $k``; ``section`` has keys, lo and hi. Code (a) is the default kind."""
    parts = lines.where(F.col(line).rlike(RANGE)).select(
        *[c for c in lines.columns if c != line],
        *(F.conv(F.regexp_extract(line, RANGE, k), 16, 10).cast("long").alias(n) for k, n in ((1, "start"), (2, "end"))),
        F.when(F.regexp_extract(line, RANGE, 3) == "", "a").otherwise(F.regexp_extract(line, RANGE, 3)).alias("kind"),
    )
    met = parts.join(section, list(keys))
    inside = (F.col("start") >= F.col("lo")) & (F.col("end") <= F.col("hi"))
    return met.where(inside).drop("lo", "hi"), met.where(~inside).drop("lo", "hi")


def optional_flag(supplementary: Column) -> Column:
    """The key Optional of a JSON column, false where it is missing."""
    return F.coalesce(F.get_json_object(supplementary, "$.Optional") == "true", F.lit(False))


def read_label_tables(insn: DataFrame, func: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, offset, optional) and (path, start, end) from relational label tables."""
    return insn.select("path", "offset", optional_flag(F.col("supplementary")).alias("optional")), func.select("path", "start", "end")


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """One row per instruction of nested functions, blocks and instructions, with its function's and block's address."""
    f = blocks.select("path", F.explode("functions").alias("f"))
    b = f.select("path", F.col("f.va").alias("func"), F.explode("f.basic_blocks").alias("b"))
    return b.select("path", "func", F.col("b.va").alias("block"), F.explode("b.instructions").alias("i")).select("path", "func", "block", F.col("i.va").alias("va"), F.col("i.size").alias("size"))


def block_extent(blocks: DataFrame) -> DataFrame:
    """(path, start, end) of all instructions; 0 and 0 for a module without any."""
    found = flatten_blocks(blocks).groupBy("path").agg(F.min("va").alias("start"), F.max(F.col("va") + F.col("size")).alias("end"))
    return blocks.select("path").join(found, "path", "left").select("path", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))


def addresses(doc: Column, key: str) -> Column:
    """Addresses of a JSON document: the array under ``key`` of an object, a list of lists laid flat, or a list; else null."""
    as_object = F.from_json(doc, f"{key} array<bigint>")[key]
    nested = F.from_json(doc, "array<array<bigint>>")
    flat = F.from_json(doc, "array<bigint>")
    kind = F.substring(F.regexp_replace(doc, r"\s", ""), 1, 2)
    return F.when(kind == "[[", F.flatten(nested)).when(F.substring(kind, 1, 1) == "[", flat).otherwise(as_object)


def manifest_paths(doc: Column) -> Column:
    """Paths of a sample manifest: the keys of an object, or a list."""
    return F.when(F.ltrim(doc).startswith("["), F.from_json(doc, "array<string>")).otherwise(F.map_keys(F.from_json(doc, "map<string,bigint>")))


def read_parquet_tolerant(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet below a folder; corrupt files are skipped, none is deleted."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(folder)


def parquet_report(spark: SparkSession, folder: str, schema) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): what can be read below a folder, and (path, length, reason) of the files that gave no row.

    The reason is ``corrupt`` for a file that does not begin and end as parquet does, else ``no rows``. Files without a byte are
    passed over by Spark and by the report.
    """
    rows = read_parquet_tolerant(spark, folder, schema)
    gave = rows.select(F.col("_metadata.file_path").alias("path")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    mark = F.lit("50415231")  # fixed value: PAR1
    whole = (F.hex(F.substring("content", 1, 4)) == mark) & (F.hex(F.substring("content", -4, 4)) == mark)
    missing = files.join(gave, "path", "left_anti")
    return rows, missing.select("path", "length", F.when(whole, "no rows").otherwise("corrupt").alias("reason"))


def explode_positions(df: DataFrame, content: str, keys: tuple[str, ...], ahead: int = 0, piece: int = 4096, decode: Callable[..., dict] | None = None, schema: str = "") -> DataFrame:
    """One row per byte: keys, off, byte and, if ``ahead``, ``window``: up to that many bytes from there on.

    ``decode`` adds the columns of ``schema`` (of type int): a function of numpy arrays, called with off, byte and the keys that
    hold integers or flags by name (with ``ahead`` also ``near``: bytes, where each row begins in them and how many of its window
    there are; the next ``ahead`` bytes after the last ones are there too, as zeros), that returns them as arrays or pairs of an array and where it is null.

    Contents are cut into pieces first, so that no row carries more than a piece; a task lays some pieces out at a time as
    arrays. Empty and null contents give none.
    """
    body = F.col(content)
    pieces = F.transform(F.sequence(F.lit(0), F.octet_length(body) - 1, F.lit(piece)), lambda s: F.struct(s.alias("_start"), F.substring(body, s + 1, F.lit(piece + max(ahead - 1, 0))).alias("_part")))
    parts = df.where(F.octet_length(body) > 0).select(*keys, F.explode(pieces).alias("_p")).select(*keys, "_p.*")
    step = max(1, (1 << 16) // piece)
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema}
    whole_numbers = [k for k, c in enumerate(keys) if kinds[c] in ("int", "bigint", "boolean")] if decode else []
    more = [x.strip().split()[0] for x in schema.split(",")] if decode else []
    names = [*keys, "off", "byte", *(["window"] if ahead else []), *more]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                *own, start, part = batch.columns
                bodies = [np.frombuffer(b, np.uint8) for b in part.to_pylist()]
                n = np.array([min(piece, len(b)) for b in bodies])
                row, at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                taken = pa.array(row)
                out = [c.take(taken) for c in own]
                out += [pa.array((start.to_numpy()[row] + at).astype(np.int32)), pa.array(np.concatenate([b[:m] for b, m in zip(bodies, n, strict=True)]).astype(np.int32))]
                if ahead:
                    out.append(_windows(bodies, n, ahead))
                if decode:
                    given = {keys[k]: out[k].to_numpy(zero_copy_only=False) for k in whole_numbers}
                    if ahead:
                        given["near"] = _laid(bodies, n, ahead)
                    new = decode(off=out[len(keys)].to_numpy(), byte=out[len(keys) + 1].to_numpy(), **given)
                    out += [pa.array(new[c][0].astype(np.int32), mask=new[c][1]) if isinstance(new[c], tuple) else pa.array(new[c].astype(np.int32)) for c in more]
                yield pa.RecordBatch.from_arrays(out, names=names)

    own = [f"`{c}` {kinds[c]}" for c in keys]
    return parts.mapInArrow(lay, ", ".join([*own, "off int", "byte int", *(["window binary"] if ahead else []), *([schema] if decode else [])]))


def _laid(bodies: list[np.ndarray], n: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bodies with zeros between them, where the first n places of each are, how many of the ``ahead`` bytes from there are a body's)."""
    none = np.zeros(2 * ahead, np.uint8)
    whole = np.concatenate([x for b in bodies for x in (b, none)])
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size + len(none)) - size - len(none)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return whole, np.repeat(first, n) + at, np.minimum(ahead, np.repeat(size, n) - at)


def _windows(bodies: list[np.ndarray], n: np.ndarray, ahead: int) -> pa.Array:
    """Up to ``ahead`` bytes from each of the first n places of each body on."""
    none = np.zeros(ahead, np.uint8)
    seen = [np.lib.stride_tricks.sliding_window_view(np.concatenate([b, none]), ahead)[:m] for b, m in zip(bodies, n, strict=True)]
    size = np.concatenate([np.minimum(ahead, len(b) - np.arange(m)) for b, m in zip(bodies, n, strict=True)])
    held = np.concatenate(seen)[np.arange(ahead) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(held))])


def byte_arrays(df: DataFrame, content: str, keys: tuple[str, ...], out: str = "values") -> DataFrame:
    """keys and the bytes of ``content`` as an array of integers; null stays null."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(len(keys))
            bodies = [np.frombuffer(b or b"", np.uint8) for b in body.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int32)
            values = pa.array(np.concatenate(bodies).astype(np.int32) if bodies else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=body.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], names=[*keys, out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    return df.select(*keys, content).mapInArrow(lay, ", ".join([*kinds, f"{out} array<int>"]))
