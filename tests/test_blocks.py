"""Graphs done block by block against the same graphs in one task, on random graphs and on long chains."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import blocks, graph, packed, postdom

EDGES = "path string, src int, dst int"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module", params=[1, 2])
def random_graph(spark, request):
    """Sparse and denser graphs with cycles, ends that are no nodes and gaps between ids."""
    rng = random.Random(request.param)
    nodes, edges = [], []
    for g in range(8):
        ids = sorted(rng.sample(range(60), 40))
        nodes += [(f"a/{g}", i, rng.random() < 0.3, rng.randint(-4, 5)) for i in ids]
        for i in ids:
            edges += [(f"a/{g}", i, rng.choice([i + 1, i + 2, rng.randrange(62)])) for _ in range(rng.choice([0, 1, request.param]))]
    return spark.createDataFrame(nodes, "path string, id int, cf boolean, w int"), spark.createDataFrame(edges, EDGES)


def stop(*_):
    raise AssertionError("the graph between blocks fits a task")


@pytest.mark.parametrize("block", [3, 10])
def test_components_and_reach_by_blocks(random_graph, block):
    nodes, edges = random_graph
    got = blocks.weak(nodes, edges, lambda e, n: graph.wcc(e, n), block)
    assert rows(got, "path", "id", "wcc") == rows(graph.wcc(edges, nodes), "path", "id", "wcc")
    first = nodes.where("id % 9 = 0").select("path", "id")
    got = blocks.reached(first, edges, lambda f, e: graph.reach_from(f, e), block)
    assert rows(got, "path", "id") == rows(graph.reach_from(first, edges), "path", "id")


@pytest.mark.parametrize("block", [3, 10])
def test_totals_by_blocks(spark, block):
    rng = random.Random(block)
    tree = [(f"a/{g}", 0, i, rng.choice([-1, *range(max(0, i - 3), i)] if g % 2 else [-1] + [j for j in range(i + 1, min(50, i + 5))] * 3)) for g in range(6) for i in range(50)]
    nodes = [(p, i, rng.random() < 0.3, rng.randint(-4, 5)) for p, _, i, _ in tree]
    tree = spark.createDataFrame(tree, "path string, wcc int, id int, ipdom int")
    nodes = spark.createDataFrame(nodes, "path string, id int, cf boolean, w long")
    got = blocks.totals(tree, nodes, "long", block)
    plain = postdom.subtree_weights(postdom._null_exit(tree), nodes)
    cols = ("path", "wcc", "id", "cf", "w", "depth", "total")
    assert rows(got, *cols) == rows(plain, *cols)
    assert blocks.totals(tree, nodes, "long", block, most=2) is None


def test_chains_over_many_blocks_leave_a_few_nodes_each(spark, monkeypatch):
    n = 5000
    nodes = spark.range(n).selectExpr("'g' as path", "cast(id as int) as id", "false as cf", "cast(id % 7 - 3 as int) as w")
    edges = nodes.where(f"id < {n - 1} and id <> 1234").selectExpr("path", "id as src", "id + 1 as dst")
    monkeypatch.setattr(graph, "wcc_by_stars", stop)
    monkeypatch.setattr(graph, "spread", stop)
    monkeypatch.setattr(postdom, "subtree_totals_by_contraction", stop)
    monkeypatch.setattr(graph.blocks, "BLOCK", 500)
    got = graph.wcc_label_propagation(edges, nodes, max_nodes=600)
    assert sorted(tuple(r) for r in got.groupBy("wcc").count().collect()) == [(0, 1235), (1235, n - 1235)]
    assert graph.reach_from(nodes.where("id = 100").select("path", "id"), edges, max_nodes=600).count() == 1135
    pdt = nodes.selectExpr("path", "0 as wcc", "id", f"if(id + 1 < {n}, id + 1, null) as ipdom")
    total, want = 0, {}
    for i in range(n):
        total = max(0, total + i % 7 - 3)
        want[i] = (n - 1 - i, total)
    assert {r.id: (r.depth, r.total) for r in postdom.subtree_weights(pdt, nodes, max_nodes=600).collect()} == want


def test_many_ends_keep_the_edges_between_them():
    import numpy as np

    ids = np.arange(200)
    own = packed.Nodes({"path": np.zeros(200, np.int64), "id": ids})
    src, dst = ids[:-1], ids[1:]
    (_, a, b), = blocks.ways(own, src, dst, ids[:100], np.array([150]))
    assert list(a) == list(range(150)) and list(b) == list(range(1, 151))
    found = blocks.ways(own, src, dst, ids[:2], np.array([150]))
    assert [(int(a[0]), int(b[0])) for _, a, b in found] == [(0, 150), (1, 150)]


@pytest.mark.parametrize("block", [3, 10])
def test_strong_components_and_trees_by_blocks(random_graph, block):
    nodes, edges = random_graph
    got = blocks.strong(nodes, edges, lambda e, n: graph.scc(e, n), block)
    assert rows(got, "path", "id", "scc") == rows(graph.scc(edges, nodes), "path", "id", "scc")
    # every loop has a way out
    nodes = nodes.withColumn("cf", F.lit(True))
    solvers = (lambda e, n: graph.wcc(e, n)), (lambda e, n: graph.scc(e, n)), (lambda e: postdom._tree_between(e, 1000))
    got = postdom._null_exit(blocks.post_dominators(nodes, edges, *solvers, block))
    assert sorted(map(str, got.select("path", "wcc", "id", "ipdom").collect())) == sorted(map(str, postdom.post_dominators(nodes, edges).select("path", "wcc", "id", "ipdom").collect()))


def test_loops_without_a_way_out_are_told(spark):
    nodes = spark.createDataFrame([("g", i, i == 9) for i in range(10)], "path string, id int, cf boolean")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(9)] + [("g", 2, 7), ("g", 7, 6)], EDGES)
    solvers = (lambda e, n: graph.wcc(e, n)), (lambda e, n: graph.scc(e, n)), (lambda e: postdom._tree_between(e, 1000))
    assert blocks.post_dominators(nodes, edges, *solvers, 3) is not None
    edges = edges.where("src <> 7 or dst = 6")
    assert blocks.post_dominators(nodes, edges, *solvers, 3) is None
    got = postdom.post_dominators(nodes, edges, max_nodes=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, postdom.post_dominators(nodes, edges).collect()))


def test_a_deep_tree_over_many_blocks(spark, monkeypatch):
    n = 5000
    nodes = spark.range(n).selectExpr("'g' as path", "cast(id as int) as id", "false as cf")
    skips = nodes.where(f"id % 5 <> 0 and id < {n - 2}").selectExpr("path", "id as src", "id + 2 as dst")
    edges = nodes.where(f"id < {n - 1}").selectExpr("path", "id as src", "id + 1 as dst").union(skips)
    monkeypatch.setattr(graph, "scc_by_colours", stop)
    monkeypatch.setattr(postdom, "post_dominators_by_meeting", stop)
    got = {r.id: (r.wcc, r.ipdom) for r in postdom.post_dominators(nodes, edges, max_nodes=600).collect()}
    up = lambda i: next(j for j in range(i, n) if j % 5 == 0 or j >= n - 2) + 1
    assert got == {i: (0, up(i) if up(i) < n else None) for i in range(n)}


def test_runs_of_neighbours_give_what_single_edges_give():
    import numpy as np

    rng = np.random.default_rng(4)
    whole = 0
    for k in range(600):
        n = int(rng.integers(1, 25))
        src = rng.integers(0, n, int(rng.integers(0, 2 * n)))
        dst = np.clip(src + rng.integers(-2, 4, len(src)), 0, n - 1) if k % 2 else rng.integers(0, n, len(src))
        assert list(packed.weak(n, src, dst)) == list(packed._weak(n, src, dst))
        first = np.unique(rng.integers(0, n, int(rng.integers(0, 4))))
        seen = set(first.tolist())
        for _ in range(n):
            seen |= {b for a, b in zip(src.tolist(), dst.tolist(), strict=True) if a in seen}
        assert set(np.flatnonzero(packed.reached(n, src, dst, first)).tolist()) == seen
        on = dst > src
        last = (np.bincount(src[on], minlength=n) == 0) | (rng.random(n) < 0.1)
        found = packed.forward_tree(n, src[on], dst[on], last)
        whole += found is not None
        assert found is None or list(found) == list(packed._post_dominator_tree(n, src[on], dst[on], last))
    assert whole > 400


def test_long_ways_to_a_meeting_are_left_to_the_plain_tree():
    import numpy as np

    # two ways of which one takes every node meet at the end only
    n = 2001
    src, dst = np.append(np.arange(n - 1), np.arange(n - 2)), np.append(np.arange(1, n), np.arange(2, n))
    last = np.arange(n) == n - 1
    want = packed._post_dominator_tree(n, src, dst, last)
    assert list(packed.post_dominator_tree(n, src, dst, last)) == list(want) and packed.forward_tree(n, src, dst, last, 5) is None


@pytest.mark.parametrize("block", [7, 50, 1000])
def test_sites_in_small_blocks_match_sql(spark, tmp_path, monkeypatch, block):
    """Pages over several blocks, blocks of several pages, a page without an id, a site of one byte."""
    import duckdb

    from seqloom import queries  # noqa: F401
    from seqloom.plans import derived
    from seqloom.plans.registry import ORACLES, QUERIES

    rng = random.Random(block)
    text = lambda n: "".join(rng.choice("dinsx ab<>é") for _ in range(n))
    pages = [(k, f"http://a.{rng.choice(['com', 'org'])}/{k}", text(rng.choice([1, 5, 20, 45, 130]))) for k in range(40)]
    pages += [(None, "http://a.com/x", "no id"), (90, "http://a.net/", "x"), (91, "no site", "dddddddddddd"), (92, "http://a.com/", ""), (93, None, "no url"), (94, "http://a.com/", None)]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(pages, schema).coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    monkeypatch.setattr(derived, "SITE_BLOCK", block)
    for name in ("g3_site_labels", "g16_site_reach", "g9_site_totals", "g6_site_tree"):
        want = con.execute(f"SELECT path, page_id, n, total, digest FROM ({ORACLES[name]})").fetchall()
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select("path", "page_id", "n", "total", "digest").collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name


def test_no_row_of_a_byte_of_a_site_is_dealt(spark):
    from seqloom import queries  # noqa: F401
    from seqloom.plans.registry import QUERIES

    # a row for each byte would be made by a second function and shuffled
    plan = QUERIES["g9_site_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Repartition" not in plan


def test_components_and_trees_in_rows_of_blocks(spark):
    """Blocks that are a row each, with edges both ways between them, against the tables."""
    import numpy as np

    rng = random.Random(11)
    n, block = 60, 10
    edges = sorted({(i, min(max(i + rng.randint(-12, 14), 0), n - 1)) for i in range(n) for _ in range(2)})
    src, dst = (np.array(c) for c in zip(*edges, strict=True))

    def decode(row):
        k = int(row.column("path")[0].as_py().split("/")[0])
        ids, on = np.arange(k * block, (k + 1) * block), src // block == k
        none = lambda x: np.zeros(len(x), np.int64)
        first = ids[ids % 20 == 0]
        return {"nodes": {"path": none(ids), "id": ids, "cf": np.ones(block, bool)}, "edges": {"path": none(src[on]), "src": src[on], "dst": dst[on]}, "entries": {"path": none(first), "id": first}}

    base = blocks.laid(spark.range(n // block).selectExpr("concat(id, '/g') as path"), decode, block)
    assert not base.one_way
    nodes = spark.range(n).selectExpr("'g' as path", "cast(id as int) as id", "true as cf")
    table = spark.createDataFrame([("g", a, b) for a, b in edges], EDGES)
    most = packed.MOST
    run = lambda found, schema: blocks.of_path(packed.in_tasks(*found, schema))
    got = run(blocks.weak_of(base, graph.between_weak(most), block), "path string, id int, wcc int")
    assert rows(got, "path", "id", "wcc") == rows(graph.wcc(table, nodes), "path", "id", "wcc")
    got = run(blocks.reached_of(base, graph.between_reach(most), block), "path string, id int")
    assert rows(got, "path", "id") == rows(graph.reach_from(nodes.where("id % 20 = 0"), table), "path", "id")
    got = run(blocks.post_dominators_of(base, graph.between_weak(most), graph.between_strong(most), postdom.between_tree(most), block), "path string, wcc int, id int, ipdom int")
    want = postdom.post_dominators(nodes, table)
    assert sorted(map(str, postdom._null_exit(got).select(*want.columns).collect())) == sorted(map(str, want.collect()))
