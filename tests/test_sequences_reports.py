"""Sequences cut at every border, runs that resume, batches that replay, reports."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import dataset, graph, insn, postdom, ranges, report
from seqloom.sources import sinks, tables
from seqloom.streaming import ingest


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randint(-5, 9), rng.random() < 0.5) for k in ("a", None, "b") for i in rng.sample(range(100), 23 if k == "a" else 4)]
    return rows, spark.createDataFrame(rows, "path string, off int, w int, optional boolean").repartition(3)


def by_key(rows):
    for key in {r[0] for r in rows}:
        yield key, sorted(r for r in rows if r[0] == key)


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
def test_windows_with_cuts_at_every_border(series, block):
    rows, df = series
    got = {(r.path, r.off): r.record for r in postdom.running_records(df, ["path"], "off", "w", block).collect()}
    assert got == {(k, r[1]): r[2] >= max([0] + [x[2] for x in own[:i]]) for k, own in by_key(rows) for i, r in enumerate(own)}
    got = {(r.path, r.off): list(r.near) for r in graph.window_neighbours(df, "path", "off", "w", 2, 3, block).collect()}
    assert got == {(k, r[1]): [x[2] for x in own[max(0, i - 2) : i + 4]] for k, own in by_key(rows) for i, r in enumerate(own)}
    got = {tuple(r) for r in ranges.optional_ranges(df, block=block).collect()}
    assert got == {(k, own[i][1], own[i + 1][1]) for k, own in by_key(rows) for i in range(len(own) - 1) if own[i][3] and not own[i + 1][3]}


def test_argmax_and_last_write(spark):
    df = spark.createDataFrame([("a", 3, 2), ("a", 1, 7), ("a", 2, 7), ("b", 1, None), ("b", 2, -4), ("c", 5, None)], "k string, i int, v int")
    assert {tuple(r) for r in dataset.argmax_first(df, ["k"], "v", "i").collect()} == {("a", 1, 7), ("b", 2, -4), ("c", 5, None)}
    df = spark.createDataFrame([("a", 0, "x", 2), ("a", 0, "y", 5), ("a", 1, "z", 1)], "path string, off int, kind string, ord int")
    assert {tuple(r) for r in ranges.last_write(df).collect()} == {("a", 0, "y"), ("a", 1, "z")}


@pytest.mark.parametrize("size", [1, 7, 64])
def test_window_closure(spark, size):
    rng = random.Random(size)
    edges = {("p/q", a, max(0, a + rng.randint(-6, 6))) for a in range(80) for _ in range(2)}
    want = set()
    for win in range(80 // size + 2):
        inside = {(a, b) for _, a, b in edges if a // size == b // size == win}
        for start in {a for a, _ in inside}:
            seen, left = set(), [start]
            while left:
                a = left.pop()
                for x, b in inside:
                    if x == a and b not in seen:
                        seen.add(b)
                        left.append(b)
            want |= {("p/q", win, start, b) for b in seen}
    got = graph.window_closure(spark.createDataFrame([*edges, (None, 1, 2)], "path string, src int, dst int"), size)
    assert {tuple(r) for r in got.select("path", "win", "src", "dst").collect()} == want


def test_runs_resume_and_replace_themselves(spark, tmp_path):
    def fail_on_seven(row):
        if row["id"] % 7 == 0:
            raise ValueError(row["id"])
        return {"id": row["id"], "twice": 2 * row["v"]}

    folder, todo = str(tmp_path / "runs"), spark.range(20).select("id", F.col("id").alias("v"))
    read = lambda name: {tuple(r) for r in spark.read.parquet(f"{folder}/{name}").collect()}
    ingest.resume(todo.where("id < 8"), "id", fail_on_seven, "id long, twice long", folder, 0)
    first = read("results"), read("failed")
    # a second run that stops before its ledger is written
    ingest.replace_batch(spark.createDataFrame([(99, 99)], "id long, twice long"), f"{folder}/results", 1, "run")
    ingest.resume(todo, "id", fail_on_seven, "id long, twice long", folder, 1)
    once = read("results"), read("failed"), read("ledger")
    assert first == ({(i, 2 * i, 0) for i in range(1, 7)}, {(i, i, f"ValueError: {i}", 0) for i in (0, 7)})
    assert once[0] == first[0] | {(i, 2 * i, 1) for i in range(8, 20) if i != 14} and once[1] == first[1] | {(14, 14, "ValueError: 14", 1)}
    assert once[2] == {(i, 0 if i < 8 else 1) for i in range(20)}
    ingest.resume(todo, "id", fail_on_seven, "id long, twice long", folder, 1)
    assert (read("results"), read("failed"), read("ledger")) == once
    ingest.resume(todo, "id", fail_on_seven, "id long, twice long", folder, 2)
    assert read("results") == once[0]


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for number, values in ((0, [1, 2]), (1, [3]), (0, [4])):
        ingest.replace_batch(spark.createDataFrame([(v,) for v in values], "v int"), sink, number)
    assert {tuple(r) for r in spark.read.parquet(sink).collect()} == {(4, 0), (3, 1)}


def test_dead_letters_keep_types_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (7, 3, None)], "id long, v int, error string")
    good, bad = sinks.with_dead_letter(df, lambda r: {"v": r["id"] // (r["id"] - 7)}, "v long")
    assert [tuple(r) for r in good.collect()] == [(-1,)]
    assert [(r[0], r[1], r[3]) for r in bad.collect()] == [(7, 3, "ZeroDivisionError: integer division or modulo by zero")]


def test_unreadable_files_are_reported(spark, tmp_path):
    schema = "id long"
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/good")
    spark.range(0).coalesce(1).write.parquet(f"{tmp_path}/empty")
    (part,) = [p for p in (tmp_path / "good").iterdir() if p.name.endswith(".parquet")]
    (tmp_path / "cut.parquet").write_bytes(part.read_bytes()[:-9])
    (tmp_path / "text.parquet").write_bytes(b"PAR1 no parquet")
    (tmp_path / "none.parquet").write_bytes(b"")
    rows, skipped = tables.parquet_report(spark, str(tmp_path), schema)
    assert sorted(r.id for r in rows.collect()) == list(range(5))
    got = {(r.path.rsplit("/", 1)[1], r.reason) for r in skipped.collect()}
    assert {("cut.parquet", "corrupt"), ("text.parquet", "corrupt")} <= got
    assert {reason for name, reason in got if name.startswith("part-")} <= {"no rows"}


@pytest.mark.parametrize("most", [10**6, 0])
def test_report_of_several_models(spark, most):
    rng = random.Random(9)
    nodes = [(p, i, rng.random() < 0.4) for p in ("x/1", "y") for i in range(14)]
    edges = [(p, i, j) for p, i, _ in nodes for j in {rng.randrange(14) for _ in range(rng.choice([0, 1, 2]))}]
    n, e = spark.createDataFrame(nodes, "path string, id int, cf boolean"), spark.createDataFrame(edges, "path string, src int, dst int")
    truth = n.select("path", F.col("id").alias("off"), (F.col("id") % 3 > 0).alias("label"), (F.col("id") > 4).alias("mask"), "cf")
    scores = spark.createDataFrame([(p, m, i, rng.uniform(-1, 2)) for p, i, _ in nodes for m in ("m1", "a/b")], "path string, model string, off int, w double")
    pdt = postdom.post_dominators(n, e).cache()
    whole, single = ({(r.path, r.model): r for r in report.prune_report(truth, scores, pdt, s).collect()} for s in (False, True))
    assert set(whole) == set(single) == {(p, m) for p in ("x/1", "y") for m in ("m1", "a/b")}
    for m in ("m1", "a/b") if most else ("m1",):
        own = scores.where(F.col("model") == m).select("path", F.col("off").alias("id"), "w").join(n, ["path", "id"])
        kept = {tuple(r) for r in postdom.prune(pdt, own, most).select("path", "id").collect()}
        wrong = [tuple(r) for r in postdom.violations(pdt, own, most).select("path", "kind").collect()]
        assert {tuple(r) for r in postdom.judge(pdt, own, most).where("kept").select("path", "id").collect()} == kept
        for p in ("x/1", "y"):
            r, s = whole[p, m], single[p, m]
            assert r.kept == sum(q == p for q, _ in kept) and s.kept == sum(q == p and i > 4 for q, i in kept)
            assert r.tp == s.tp == sum(q == p and i > 4 and i % 3 > 0 for q, i in kept)
            assert s.fps == sorted(i for q, i in kept if q == p and i > 4 and i % 3 == 0)
            assert s.fns == [i for i in range(5, 14) if i % 3 > 0 and (p, i) not in kept]
            assert [r[k] for k in ("dangling", "exclusive", "coexist")] == [wrong.count((p, k)) for k in ("dangling", "exclusive", "coexist")]


def test_byte_counts_and_modes(spark):
    corpus = spark.createDataFrame([("a", bytearray(b"\x00\xff\x00")), ("b", bytearray()), ("c", None)], "path string, content binary")
    assert {(r.path, r.opcode, r.n) for r in insn.opcode_counts(corpus).collect()} == {("a", 0, 2), ("a", 255, 1)}
    rows = spark.createDataFrame([("48C3", True), ("48C3", False), ("C5F877", False), ("C50177", False), ("620177", False), ("66", True)], "hex string, is64 boolean")
    got = [(r.opcode, r.opcode_len, r.modrm) for r in insn.opcode_key(rows).collect()]
    assert got == [(0xC3, 1, 0), (0x48, 1, 0xC3), (0x77, 2, 0), (0xC5, 1, 1), (0x62, 1, 1), (None, None, None)]


@pytest.mark.parametrize("size", [1, 4, 16, 100])
def test_painting_against_plain(spark, size):
    rng = random.Random(size)
    marks = [(p, o, s, s + rng.randint(-1, 30), rng.choice("aid")) for p in "xy" for o, s in enumerate(rng.choices(range(-5, 40), k=25))]
    positions = [(p, off) for p in "xyz" for off in range(-6, 60)]
    at, over = spark.createDataFrame(positions, "path string, off int"), spark.createDataFrame(marks, "path string, ord int, start int, end int, kind string")

    def last(p, off, kinds):
        return max(((o, k) for q, o, s, e, k in marks if q == p and s <= off < e and k in kinds), default=(None, None))

    got = {tuple(r) for r in ranges.paint(at, over, bin_size=size).collect()}
    assert got == {(p, off, *last(p, off, "aid")) for p, off in positions if last(p, off, "aid")[1]}
    got = {tuple(r) for r in ranges.paint_masks(at, over, bin_size=size).select("path", "off", "mask", "data").collect()}
    assert got == {(p, off, last(p, off, "aid")[1] in ("a", "d"), last(p, off, "ad")[1] == "d") for p, off in positions}


def test_spans_of_positions_are_painted_as_their_rows(spark):
    rng = random.Random(5)
    marks = [(p, o % 40, s, s + rng.randint(-1, 150), rng.choice(["a", "i", "d", "x", None])) for p in ("x", "y", None) for o, s in enumerate(rng.choices(range(-90, 160), k=60))]
    over = spark.createDataFrame(marks, "path string, ord int, start int, end int, kind string")
    spans = [("x", -100, 200), ("y", -3, 64), ("y", 64, 65), ("y", 70, 70), ("z", 0, 130), (None, 0, 5)]
    rows = spark.createDataFrame([(p, off) for p, s, e in spans for off in range(s, e)], "path string, off int")
    whole = ranges.paint_masks(spark.createDataFrame(spans, "path string, start int, end int"), over)

    def last(p, off, kinds):
        return max(((o, k or "", k) for q, o, s, e, k in marks if p and q == p and s <= off < e and k in kinds), default=(0, "", None))[2]

    want = sorted((str(p), off, last(p, off, ["a", "i", "d", "x", None]) in ("a", "d"), last(p, off, ["a", "d", "x"]) == "d") for p, s, e in spans for off in range(s, e))
    for got in (whole, ranges.paint_masks(rows, over, bin_size=7)):
        assert sorted((str(r.path), r.off, r.mask, r["data"]) for r in got.collect()) == want
    assert dict(whole.dtypes)["off"] == "int"
    # no row of a position is dealt
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(cast(greatest") < plan.index("Join LeftOuter")
