"""Digests of pages made in arrays, against hashlib and against tables of rows."""

import hashlib

import numpy as np
import pytest

from seqloom import queries  # noqa: F401
from seqloom.functions import digests
from seqloom.plans.registry import DEFINED, QUERIES, Tables


def code(text):
    return int(hashlib.md5(text).hexdigest()[:8], 16)


@pytest.mark.parametrize("filler", [0, 1, 20, 41, 60, 130])
def test_codes_are_those_of_hashlib(filler):
    rng = np.random.default_rng(filler)
    names = [b"1", b"four", b"fifteen letters", "é".encode(), b""]
    which, number, signed, flat = rng.integers(0, 5, 900), rng.integers(0, 10 ** rng.integers(1, 13, 900)), rng.integers(-12, 12, 900), np.full(900, 10_000)
    fields = [b"z" * filler, (digests.Texts(names), which), b"|", number, b"|", signed, flat]
    want = [code(b"z" * filler + names[w] + b"|%d|%d%d" % (a, b, c)) for w, a, b, c in zip(which, number.tolist(), signed.tolist(), flat.tolist(), strict=True)]
    assert digests.codes(fields, 900).tolist() == want
    assert digests.codes([b"z" * filler], 2).tolist() == [code(b"z" * filler)] * 2
    assert digests.codes([b"z", np.empty(0, np.int64)], 0).tolist() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Short and long pages, one without a byte, one without a text, two with one number, one without a number."""
    path = str(tmp_path_factory.mktemp("pages"))
    text = "".join(chr(33 + (i * i * 7 + i) % 90) for i in range(700))
    rows = [(i, text[i * 5 : i * 5 + 3 + i * 9 % 80]) for i in range(40)] + [(40, ""), (41, None), (42, "aé" * 50), (7, text[:60]), (123456789, text * 20), (None, text[:30])]
    rows += [(50 + i, text[i]) for i in range(20)]
    spark.createDataFrame([(i, f"http://x.y/{i}", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["p13_windows", "j8_neighbours", "j4_overlaps"])
def test_digests_in_arrays_are_those_of_rows(spark, folder, name):
    fn, own = DEFINED[name]
    want = {}
    for r in fn(Tables(spark, folder, "html")).collect():
        n, total = want.get(r.path, (0, 0))
        want[r.path] = n + 1, total + code("|".join("~" if r[c] is None else str(r[c]) for c, _ in own).encode())
    df = QUERIES[f"{name}_html"](spark, folder)
    assert {r.path: (r.rows, r.digest) for r in df.collect()} == want
    assert {None, "7", "42", "123456789"} <= set(want)


@pytest.mark.parametrize("name", ["p13_windows", "j8_neighbours", "j4_overlaps"])
def test_no_row_of_a_byte_leaves_the_task_that_has_the_page(spark, name):
    plan = QUERIES[f"{name}_html"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "md5" not in plan


def test_traces_in_arrays_are_those_of_rows(spark, folder):
    fn, own = DEFINED["g12_trace"]
    want = {}
    for r in fn(Tables(spark, folder, "html")).collect():
        n, total = want.get(r.path, (0, 0))
        want[r.path] = n + 1, total + code("|".join("~" if r[c] is None else str(r[c]) for c, _ in own).encode())
    df = QUERIES["g12_trace_html"](spark, folder)
    assert {r.path: (r.rows, r.digest) for r in df.collect()} == want
    plan = QUERIES["g12_trace_html"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "md5" not in plan
