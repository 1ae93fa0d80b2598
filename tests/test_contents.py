"""Graphs made in the task that holds the page, against tables of nodes and edges."""

import pytest

from seqloom.operators import graph, metrics, packed, postdom, report
from seqloom.plans import derived
from seqloom.plans.registry import DEFINED, QUERIES, Tables
from seqloom import queries  # noqa: F401


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Short and long pages, one without a byte, one without a text, two with one number."""
    folder = tmp_path_factory.mktemp("pages")
    text = "".join(chr(33 + (i * i * 7 + i) % 90) for i in range(700))
    rows = [(i, text[i * 5 : i * 5 + 3 + i * 9 % 80]) for i in range(40)] + [(40, ""), (41, None), (42, "aé" * 50), (7, text[:60]), (43, text)]
    spark.createDataFrame([(i, f"http://x.y/{i}", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return Tables(spark, str(folder), "html")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("pack", [1, 100, packed.PACK])
def test_whole_graphs_are_those_of_the_tables(pages, pack):
    contents, rest = derived.url_graphs(pages, most=500)
    assert {r.path for r in rest.select("path").collect()} == {"7", "43"}
    own = pages.pages.where("html is not null and page_id not in (7, 43)")
    nodes, edges = derived.url_graph(pages, own.selectExpr("cast(page_id as string) as path", "encode(html, 'UTF-8') as content"))
    assert rows(contents.in_tasks(graph._weak, graph.WCC, pack)) == rows(graph.wcc(edges, nodes))
    assert rows(contents.in_tasks(graph._strong, graph.SCC, pack)) == rows(graph.scc(edges, nodes))
    assert rows(contents.in_tasks(lambda g: g["edges"], "path string, src int, dst int", pack)) == rows(edges)


@pytest.mark.parametrize("name", ["g2_wcc", "g4_scc", "g6_post_dominators", "g9_weights", "g10_prune", "g11_violations", "g13_window_closure"])
def test_queries_over_odd_pages(pages, name):
    nodes, edges = derived.url_graph(pages)
    pdt = postdom.post_dominators(nodes, edges)
    want = {
        "g2_wcc": lambda: graph.wcc(edges, nodes), "g4_scc": lambda: graph.scc(edges, nodes), "g6_post_dominators": lambda: pdt, "g9_weights": lambda: postdom.subtree_weights(pdt, nodes),
        "g10_prune": lambda: postdom.prune(pdt, nodes), "g11_violations": lambda: postdom.violations(pdt, nodes), "g13_window_closure": lambda: graph.window_closure(edges, 16),
    }[name]()
    got = DEFINED[name][0](pages)
    assert rows(got.select(*want.columns)) == rows(want)


def test_nothing_of_a_whole_graph_is_dealt(pages):
    contents, _ = derived.url_graphs(Tables(pages.spark, pages.sf_dir))
    for found in (graph.wcc_of(contents), graph.scc_of(contents), postdom.violations_of(contents), graph.window_closure_of(contents, 16)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Repartition" not in plan and "Sort" not in plan


def test_strong_components_look_where_edges_go_back(monkeypatch):
    import numpy as np

    seen = []
    plain = packed._strong
    monkeypatch.setattr(packed, "_strong", lambda n, *e: seen.append(n) or plain(n, *e))
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        src = rng.integers(0, n, int(rng.integers(0, 2 * n)))
        dst = np.clip(src + rng.integers(-3, 6, len(src)), 0, n - 1)
        assert list(packed.strong(n, src, dst)) == list(plain(n, src, dst))
    seen.clear()
    n = 1000
    assert list(packed.strong(n, np.append(np.arange(n - 1), 20), np.append(np.arange(1, n), 10))) == [10 if 10 <= i <= 20 else i for i in range(n)]
    assert seen == [11]


def test_opcode_keys_in_arrays_are_those_of_hex_windows(spark):
    import random

    from pyspark.sql import functions as F

    from seqloom.operators import insn

    rng = random.Random(5)
    often = [0x26, 0x66, 0xF2, 0xF3, 0x48, 0x4F, 0xC5, 0xC4, 0x62, 0x0F, 0x38, 0x3A, 0x3F, 0xC0, 0xFF]
    content = [bytes(rng.choice(often) if rng.random() < 0.8 else rng.randrange(256) for _ in range(n)) for n in (1, 2, 14, 15, 16, 30, 300, 5000)] + [b"\x66" * 40, b"\x48" * 20, b"\x0f", b""]
    corpus = spark.createDataFrame([(f"{k}/{x64}", x64, bytearray(c)) for k, c in enumerate(content) for x64 in (True, False, None)], "path string, is64 boolean, content binary")
    got = insn.superset(corpus)
    plain = insn.with_rules(insn.opcode_key(got.select("path", "is64", "off", "byte", "hex")))
    cols = ("path", "is64", "off", "byte", "hex", "opcode", "opcode_len", "modrm", "kind")
    assert rows(got.select(*cols)) == rows(plain.select(*cols)) and got.count() == 3 * sum(map(len, content))
    # nothing is looked for in text
    assert "regexp" not in got.select(F.count("opcode"))._jdf.queryExecution().optimizedPlan().toString()


def test_flags_over_odd_pages(pages):
    i = derived.url_insn(pages)
    flagged = lambda flag: i.where(f"mask and {flag}").select("path", "off")
    got = DEFINED["u5_intersect"][0](pages)
    assert rows(got) == rows(flagged("pred").intersect(flagged("label"))) and got.count() > 100
    contents, _ = derived.url_contents(pages, derived.url_flags)
    # one pass over pages, nothing is dealt to meet
    plan = metrics.both_of(contents, "pred", "label")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Intersect" not in plan


def test_ranges_over_odd_pages(pages):
    from pyspark.sql import functions as F

    i = derived.url_insn(pages)
    at = lambda flag: i.where(flag).select("path", F.col("off").alias("addr"))
    own = derived.url_corpus(pages).where("path <> '7'").selectExpr("path", "2 as start", "octet_length(content) - 2 as end")
    want = metrics.confusion_ranges(at("pred"), at("label"), own)
    got = DEFINED["a2_confusion_ranges"][0](pages)
    assert rows(got.where("path <> '7'").select(*want.columns)) == rows(want)


def test_single_reports_over_odd_pages(pages):
    cols = ("path", "kept", "fps", "fns", "dangling", "exclusive", "coexist")
    want = queries.single_by_rows(pages, derived.url_corpus(pages)).select(*cols)
    assert rows(DEFINED["x6_prune_single"][0](pages).select(*cols)) == rows(want)
    contents, rest = derived.url_contents(pages, derived.url_truth, most=500)
    got = report.prune_single_of(contents).unionByName(queries.single_by_rows(pages, rest).select(*report.prune_single_of(contents).columns))
    assert rows(got.select(*cols)) == rows(want) and want.where("fps <> '' and fns <> ''").count() > 10


def test_no_row_of_a_byte_of_a_single_report_is_dealt(spark):
    plan = QUERIES["x6_prune_single_html"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
