"""Sources, sinks, ranges, chunks, keys and streams on small golden cases."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import chunks, dataset, insn, metrics, ranges, runs
from seqloom.sources import sinks, tables
from seqloom.streaming import ingest


def test_magic(spark, tmp_path):
    elf = b"\x7fELF" + b"\0" * 12
    for name, data in {"a/x": elf + b"\x02\0", "a/core": elf + b"\x04\0", "m": b"\xcf\xfa\xed\xfe..", "p.exe": b"MZ\x90\0..", "t": b"text", "empty": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path.rsplit("/", 1)[1]: r.format for r in tables.scan_by_magic(spark, str(tmp_path)).collect()} == {"x": "ELF", "m": "MachO", "p.exe": "PE"}


def test_hex_lines_and_ranges(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0x10\n  ff \nnone\n0xffffffffffffffff\n")
    assert sorted(int(r.addr) for r in tables.read_hex_lines(spark, str(tmp_path)).collect()) == [16, 255, 2**64 - 1]
    lines = spark.createDataFrame([("f", 0, "0x402ed4-0x402ed9"), ("f", 1, "0x402ed9-0x402ef4 $d"), ("f", 2, "0x0-0x5 $i"), ("f", 3, "junk")], "path string, ord int, line string")
    section = spark.createDataFrame([("f", 0x402000, 0x403000)], "path string, lo long, hi long")
    ok, no = tables.parse_ranges(lines, section)
    assert {(r.ord, r.kind, r.end - r.start) for r in ok.collect()} == {(0, "a", 5), (1, "d", 27)}
    assert [r.ord for r in no.collect()] == [2]


def test_addresses_and_manifest(spark):
    docs = spark.createDataFrame([('{"instructions": [1, 2]}',), ("[[1], [2, 3]]",), (" [7]",), ("{bad",), (None,)], "d string")
    assert [r[0] for r in docs.select(tables.addresses(F.col("d"), "instructions")).collect()] == [[1, 2], [1, 2, 3], [7], None, None]
    lists = spark.createDataFrame([('["a", "b"]',), ('{"c": 1}',)], "d string")
    assert [r[0] for r in lists.select(tables.manifest_paths(F.col("d"))).collect()] == [["a", "b"], ["c"]]


def test_blocks_and_extent(spark):
    schema = "path string, functions array<struct<va:bigint, basic_blocks:array<struct<va:bigint, instructions:array<struct<va:bigint, size:int>>>>>>"
    blocks = spark.createDataFrame([("f", [(16, [(16, [(16, 2), (18, 3)])])]), ("empty", [])], schema)
    assert {tuple(r) for r in tables.flatten_blocks(blocks).collect()} == {("f", 16, 16, 16, 2), ("f", 16, 16, 18, 3)}
    assert {tuple(r) for r in tables.block_extent(blocks).collect()} == {("f", 16, 21), ("empty", 0, 0)}


def test_sinks(spark, tmp_path):
    files = spark.range(10).select(F.col("id").cast("string").alias("path"), F.lit(b"x").alias("gt")).coalesce(1)
    sinks.pack_corpus(files, str(tmp_path / "pack"), 4)
    assert len(list((tmp_path / "pack").glob("*.parquet"))) == 3
    (tmp_path / "pack" / "bad.parquet").write_bytes(b"not parquet")
    assert tables.read_parquet_tolerant(spark, str(tmp_path / "pack"), files.schema).count() == 10
    v = spark.createDataFrame([("f", "dangling", 255, 3)], "path string, kind string, addr long, off int")
    sinks.write_report(v, str(tmp_path / "report"))
    assert {r.value for r in spark.read.text(str(tmp_path / "report")).collect()} == {"dangling f 0xff[3]", "# dangling: 1"}
    sinks.write_summary(v, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 1
    sinks.write_results(v.withColumns({"dataset": F.lit("d"), "model": F.lit("m")}), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).where("dataset = 'd' and model = 'm'").count() == 1


def test_dead_letters(spark):
    ok, bad = sinks.with_dead_letter(spark.createDataFrame([(1,), (0,)], "x long"), lambda r: {"y": 10 / r["x"]}, "y double")
    assert [r.y for r in ok.collect()] == [10.0]
    assert [(r.x, r.error.split(":")[0]) for r in bad.collect()] == [(0, "ZeroDivisionError")]


def test_option_keys(spark):
    def keys(path, grammar):
        k = spark.range(1).select(scalars.option_keys(F.lit(path), grammar).alias("k")).first().k
        return tuple(k) if k else None

    assert keys("linux/utils/binutils/gcc_m32_Os/elfedit", "sok") == ("gcc", "Os", "x32")
    assert keys("linux/utils/binutils/gcc_Os/elfedit", "sok") == ("gcc", "Os", "x64")
    assert keys("freetype/obfuscated/ollvm/opaque/100/freetype_ollvm_clang14_x64_opaque_100_5_O0.exe", "quarks") == ("ollvm", "opaque", "O0")
    assert keys("freetype/sources/freetype_clang14_x64_O0.exe", "quarks") == (None, None, "O0")
    assert keys("a/gcc32/O2/x", "rw") == ("gcc32", "O2", "x86")
    assert keys("short", "rw") is None


def test_overlaps_golden(spark):
    i = spark.createDataFrame([("f", k, n) for k, n in enumerate([5, 4, 3, 2, 1])], "path string, off int, len int")
    got = {}
    for r in ranges.overlaps(i, "before").collect():
        got.setdefault(r.off, set()).add(r.other)
    assert got == {1: {0}, 2: {0, 1}, 3: {0, 1, 2}, 4: {0, 1, 2, 3}}


def test_chunk_golden(spark):
    df = spark.createDataFrame([("f", list(range(10)))], "path string, values array<int>")
    c = chunks.chunk(df, "values", 6, 1, 1)
    valid = {r.start: [r.start + k for k, m in enumerate(r.mask) if m] for r in c.collect()}
    assert valid == {0: [0, 1, 2, 3, 4], 4: [5, 6, 7, 8], 8: [9]}
    assert chunks.stitch_arrays(c).first()["values"] == list(range(10))
    with pytest.raises(ValueError):
        chunks.chunk(df, "values", 2, 1, 1)


@pytest.mark.parametrize("left, right", [(0, 0), (0, 2), (2, 2), (1, 3), (2, 0)])
def test_chunks_cover_once(spark, left, right):
    df = spark.createDataFrame([(str(n), list(range(n))) for n in range(1, 30)], "path string, values array<int>")
    got = chunks.stitch(chunks.chunk(df, "values", 8, left, right))
    counts = {(r.path, r.off): r["count"] for r in got.groupBy("path", "off").count().collect()}
    if right or not left:
        assert counts == {(str(n), k): 1 for n in range(1, 30) for k in range(n)}


def test_opcode_key_and_kinds(spark):
    cases = {"90": (0x90, 1, 0, 1), "E800": (0xE8, 1, 0, 2), "48C3": (0xC3, 1, 0, 3), "0F84": (0x84, 2, 0, 5), "66": None, "FFE0": (0xFF, 1, 0xE0, 4), "FFD0": (0xFF, 1, 0xD0, 2), "0F05": (5, 2, 0, 6), "0F38F0": (0xF0, 3, 0, 1), "0F01C1": (1, 2, 0xC1, 6), "F4": (0xF4, 1, 0, 9)}
    df = spark.createDataFrame([(h, True) for h in cases], "hex string, is64 boolean")
    got = {r.hex: (r.opcode, r.opcode_len, r.modrm, r.kind) for r in insn.with_rules(insn.opcode_key(df)).collect()}
    for h, want in cases.items():
        assert got[h] == (want or (None, None, None, 0)), h
    short = insn.with_rules(insn.opcode_key(spark.createDataFrame([("48C3", False), ("C50000", False)], "hex string, is64 boolean")))
    assert {r.hex: (r.opcode, r.opcode_len) for r in short.collect()} == {"48C3": (0x48, 1), "C50000": (0xC5, 1)}


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([("mov add mov",), (None,), ("",)], "t string")
    merges = [("m", "o"), ("mo", "v"), ("a", "d")]
    vocab = {x: k + 2 for k, x in enumerate(["mov", "ad", "d"])}
    out = dataset.encode(df, "t", merges, vocab, most=6)
    assert [list(r.ids) for r in out.collect()] == [[2, 3, 4, 2, 0, 0], [0] * 6, [0] * 6]
    n = {(r.a, r.b): r.n for r in dataset.merge_counts(dataset.word_counts(df, "t"), merges).collect()}
    assert n == {("ad", "d"): 1}


def test_bucket_singletons(spark):
    df = spark.createDataFrame([(str(k), n) for k, n in enumerate([1, 2, 3, 9, 10, 11, 12, 13])], "path string, n int")
    assert {r.n for r in dataset.bucket_pick(df, "n").collect()} == {2, 3, 9, 11, 13}
    assert {r.n for r in dataset.bucket_pick(df, "n", keep_singletons=True).collect()} == {1, 2, 3, 9, 11, 13}


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "pred boolean, label boolean, mask boolean, g string")
    assert metrics.confusion(none, ["g"]).count() == 0
    assert runs.histogram(spark.createDataFrame([(5,), (5,)], "n int"), "n", 10).collect()[0].asDict() == {"bin": 0, "n": 2}


def test_streams(spark, tmp_path):
    src, sink, point = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([(True, True, True), (True, False, True)], "pred boolean, label boolean, mask boolean")
    rows.write.parquet(src)
    ingest.ingest_once(spark, src, rows.schema, sink, point).awaitTermination()
    ingest.ingest_once(spark, src, rows.schema, sink, point).awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    rows.write.mode("append").parquet(src)
    ingest.ingest_once(spark, src, rows.schema, sink, point).awaitTermination()
    assert spark.read.parquet(sink).count() == 4
    ingest.metrics_per_batch(spark.readStream.schema(rows.schema).parquet(src), str(tmp_path / "m"), str(tmp_path / "mck")).awaitTermination()
    assert [r.precision for r in spark.read.parquet(str(tmp_path / "m")).collect()] == [0.5]


def test_bytes_are_the_same_whatever_the_piece(spark):
    data = [("a", bytes(range(50))), ("b", b""), ("c", None), ("d", b"x"), ("e", bytes(200 - i for i in range(33)))]
    df = spark.createDataFrame(data, "path string, content binary")
    want = sorted((p, i, c[i], c[i : i + 5]) for p, c in data for i in range(len(c or b"")))
    for piece in (1, 7, 4096):
        got = tables.explode_positions(df, "content", ("path",), ahead=5, piece=piece).collect()
        assert sorted((r.path, r.off, r.byte, bytes(r.window)) for r in got) == want
        assert sorted(tuple(r) for r in tables.explode_positions(df, "content", ("path",), piece=piece).collect()) == [w[:3] for w in want]


def test_ranks_over_ranges(spark):
    rows = [(g, v % 7, v) for g, n in (("a", 40), (None, 9), ("b", 1)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r.g, r.id): r.rank for r in dataset.ranked(df, "g", [F.desc("v"), F.col("id")]).collect()}
    for g in ("a", None, "b"):
        own = sorted(((-v, i) for h, v, i in rows if h == g))
        assert [got[g, i] for _, i in own] == list(range(len(own)))
    weighed = {(r.g, r.id): r.rank for r in dataset.ranked(df, "g", [F.col("id")], weight="v").collect()}
    assert all(weighed[g, i] == sum(v for h, v, j in rows if h == g and j < i) for g, _, i in rows)


def test_medians_of_counted_values(spark):
    rows = [("a", float(k % 5)) for k in range(21)] + [("b", 2.0), ("b", 3.0), ("b", None), ("c", None), (None, 4.0)]
    got = {r.tool: (r.runs, r.errors, r.median) for r in runs.runtime_summary(spark.createDataFrame(rows, "tool string, runtime double")).collect()}
    assert got == {"a": (21, 0, 2.0), "b": (3, 1, 2.5), "c": (1, 1, None), None: (1, 0, 4.0)}


def test_overlaps_need_no_row_per_file(spark):
    rows = [(p, k, (k * 7) % 18, n) for p, n in (("f", 40), ("g", 3)) for k in range(n)]
    i = spark.createDataFrame(rows, "path string, off int, len int, n int")
    for side in ("after", "before"):
        alone, told = ranges.overlaps(i, side), ranges.overlaps(i, side, size="n")
        assert sorted(alone.collect()) == sorted(told.collect()) and alone.count()
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (alone, told)]
        assert "Broadcast" not in plans[0] and "Join" not in plans[1]


def test_a_long_page_is_chunked_in_proportion(spark, tmp_path):
    import time

    from seqloom import queries
    from seqloom.plans.registry import Tables

    text = "".join(chr(33 + k % 90) for k in range(300_000))
    spark.createDataFrame([(1, "u", text), (2, "v", "x"), (3, "w", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    began = time.time()
    got = queries.a18_stitch(Tables(spark, str(tmp_path), "html")).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.expr("(off % 1009 + 1) * value")).alias("d")).collect()
    assert {r.path: (r.n, r.d) for r in got} == {"1": (300_000, sum((k % 1009 + 1) * ord(c) for k, c in enumerate(text))), "2": (1, 120)}
    assert time.time() - began < 60


def test_chunks_keep_nulls_and_label_masks(spark):
    rows = [("a", [1, None, 3, 4, 5], [True, None, True]), ("b", [7, 8], None), ("c", [], [True]), ("d", None, [True])]
    df = spark.createDataFrame(rows, "path string, values array<int>, m array<boolean>")
    got = {(r.path, r.chunk): (r.start, r["values"], r["mask"]) for r in chunks.chunk(df, "values", 4, 0, 1, label_mask="m").collect()}
    assert got == {("a", 0): (0, [1, None, 3, 4], [True, None, True, False]), ("a", 1): (3, [4, 5, 0, 0], [False] * 4), ("b", 0): (0, [7, 8, 0, 0], None)}


def test_files_of_the_tolerant_read_grow_with_the_documents(spark, tmp_path):
    import glob

    from seqloom import queries
    from seqloom.plans.lineage import shared_dir
    from seqloom.plans.registry import Tables

    spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "land")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    assert queries.s10_tolerant(Tables(spark, str(tmp_path), "url")).where("kind = 'row'").count() == 50_000
    folder = shared_dir(spark).removeprefix("file://")
    assert max(len(glob.glob(f"{f}/good/*.parquet")) for f in glob.glob(f"{folder}/tolerant-*")) == 10
