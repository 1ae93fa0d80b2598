"""Graph operators on golden cases and against brute force on random graphs."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import graph, packed, postdom

NODES, EDGES = "path string, id int, cf boolean, w int", "path string, src int, dst int"


def random_graphs(seed, graphs, size):
    rng = random.Random(seed)
    nodes, edges = [], []
    for g in range(graphs):
        n = rng.randint(2, size)
        nodes += [(f"g{g}", i, rng.random() < 0.4, rng.randint(-4, 5)) for i in range(n)]
        for i in range(n):
            edges += [(f"g{g}", i, j) for j in {rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 2]))}]
    return nodes, edges


def by_path(nodes, edges):
    for g in sorted({r[0] for r in nodes}):
        yield g, {i: (cf, w) for p, i, cf, w in nodes if p == g}, {(a, b) for p, a, b in edges if p == g}


def reach(start, ahead):
    seen, left = set(start), list(start)
    while left:
        for j in ahead.get(left.pop(), ()):
            if j not in seen:
                seen.add(j)
                left.append(j)
    return seen


def ahead_of(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


def brute_components(own, pairs):
    both = ahead_of(pairs | {(b, a) for a, b in pairs})
    return {i: min(reach([i], both)) for i in own}


def brute_scc(own, pairs):
    fw, bw = ahead_of(pairs), ahead_of({(b, a) for a, b in pairs})
    return {i: min(reach([i], fw) & reach([i], bw)) for i in own}


def brute_exit(own, pairs):
    strong = brute_scc(own, pairs)
    leaving = {strong[a] for a, b in pairs if strong[a] != strong[b]}
    return {i for i in own if strong[i] not in leaving and (sum(s == strong[i] for s in strong.values()) == 1 or own[i][0])}


def brute_tree(own, pairs):
    """Post-dominators by removing each node and asking for the exit."""
    every = pairs | {(i, -1) for i in brute_exit(own, pairs)}
    ahead = ahead_of(every)
    can = {i for i in own if -1 in reach([i], ahead)}
    above = {i: {d for d in can if d != i and -1 not in reach([i], ahead_of({e for e in every if d not in e}))} for i in can}
    return {i: max(above[i], key=lambda d: len(above[d]), default=None) for i in can}


@pytest.fixture(scope="module")
def data(spark):
    nodes, edges = random_graphs(3, 12, 14)
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.fixture(scope="module")
def few(spark):
    """Fewer graphs, for what takes a job per step."""
    nodes, edges = random_graphs(8, 4, 12)
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_golden_components(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(7)], "path string, id int")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 0), ("g", 3, 4)], EDGES)
    want = {("g", i, c) for i, c in enumerate([0, 0, 0, 3, 3, 5, 6])}
    assert rows(graph.wcc(edges, nodes), "path", "id", "wcc") == want
    assert rows(graph.wcc_label_propagation(edges, nodes), "path", "id", "wcc") == want
    window = rows(graph.component_window(graph.wcc(edges, nodes), 1, 1), "id", "delta", "same")
    assert {(0, -1, False), (0, 1, True), (2, 1, False), (4, -1, True), (6, 1, False)} <= window


def test_components(data):
    nodes, edges, n, e = data
    want = {(g, i, c) for g, own, pairs in by_path(nodes, edges) for i, c in brute_components(own, pairs).items()}
    assert rows(graph.wcc(e, n), "path", "id", "wcc") == want
    assert rows(graph.wcc(e.select("path", F.col("dst").alias("src"), F.col("src").alias("dst")), n), "path", "id", "wcc") == want


@pytest.mark.parametrize("of", ["data", "few"])
def test_strong_components_both_ways(of, request):
    nodes, edges, n, e = request.getfixturevalue(of)
    want = {(g, i, c) for g, own, pairs in by_path(nodes, edges) for i, c in brute_scc(own, pairs).items()}
    assert rows(graph.scc(e, n), "path", "id", "scc") == want
    assert of == "data" or rows(graph.scc_by_colours(e, n, block=5), "path", "id", "scc") == want


@pytest.mark.parametrize("of", ["data", "few"])
def test_post_dominators_both_ways(of, request):
    nodes, edges, n, e = request.getfixturevalue(of)
    want = {(g, i, d) for g, own, pairs in by_path(nodes, edges) for i, d in brute_tree(own, pairs).items()}
    assert rows(postdom.post_dominators(n, e), "path", "id", "ipdom") == want
    assert of == "data" or rows(postdom.post_dominators(n, e, max_nodes=0), "path", "id", "ipdom") == want


def tree_of(nodes, edges):
    for g, own, pairs in by_path(nodes, edges):
        up = brute_tree(own, pairs)
        kids = {}
        for i, d in up.items():
            kids.setdefault(d, []).append(i)
        yield g, own, up, kids


def test_prune(spark, data):
    nodes, edges, n, e = data
    want = set()
    for g, own, _up, kids in tree_of(nodes, edges):

        def total(i, own=own, kids=kids):
            return max(0, own[i][1] + sum(total(k) for k in kids.get(i, [])))

        left = [i for i in kids.get(None, []) if own[i][0] and total(i) > 0]
        while left:
            i = left.pop()
            want.add((g, i))
            below = [k for k in kids.get(i, []) if total(k) > 0]
            left += [k for k in below if own[k][0]]
            other = sorted((k for k in below if not own[k][0]), key=lambda k: (-total(k), k))
            left += other[:1]
    assert rows(postdom.prune(postdom.post_dominators(n, e), n), "path", "id") == want


def test_totals_both_ways(few):
    nodes, edges, n, e = few
    pdt = postdom.post_dominators(n, e)
    columns = ("path", "id", "depth", "total")
    assert rows(postdom.subtree_weights(pdt, n), *columns) == rows(postdom.subtree_weights(pdt, n, max_nodes=0), *columns)


def test_violations(data):
    nodes, edges, n, e = data
    want = set()
    for g, own, up, kids in tree_of(nodes, edges):

        def chain(i, up=up):
            while i is not None:
                yield i
                i = up[i]

        for i, d in up.items():
            w = own[i][1]
            if w > 0 and not own[i][0] and d is None:
                want.add((g, i, "dangling"))
            if d is not None and all(own[x][1] > 0 for x in list(chain(d))[1:]):
                if w > 0 and own[d][1] <= 0 and own[list(chain(i))[-1]][0]:
                    want.add((g, i, "coexist"))
                if own[d][1] > 0 and not own[i][0]:
                    best, hits = 0, []
                    for k in sorted(k for k in kids[d] if not own[k][0]):
                        if own[k][1] >= best:
                            best = own[k][1]
                            hits += [k] if own[k][1] > 0 else []
                    if len(hits) >= 2 and i in hits:
                        want.add((g, i, "exclusive"))
    assert rows(postdom.violations(postdom.post_dominators(n, e), n), "path", "id", "kind") == want


@pytest.mark.parametrize("weights, flagged", [([1, 2], {1, 2}), ([2, 1], set()), ([1, 1], {1, 2})])
def test_exclusive_depends_on_order(spark, weights, flagged):
    pdt = spark.createDataFrame([("g", 0, 0, None), ("g", 0, 1, 0), ("g", 0, 2, 0)], postdom.PDT)
    nodes = spark.createDataFrame([("g", 0, True, 1)] + [("g", k + 1, False, w) for k, w in enumerate(weights)], NODES)
    assert {r.id for r in postdom.violations(pdt, nodes).where("kind = 'exclusive'").collect()} == flagged


def test_reclassify(spark):
    v = [("dangling", "nop", None), ("dangling", " lock inc", None), ("coexist", "mov", "nop"), ("coexist", "add", "mov"), ("exclusive", "nop", "mov")]
    out = postdom.reclassify(spark.createDataFrame(v, "kind string, text string, parent_text string"))
    assert sorted(r.kind for r in out.collect()) == ["coexist", "exclusive", "nop"]


def test_sweep_and_reach(spark):
    insn = spark.createDataFrame([("g", k, n) for k, n in enumerate([2, 1, 3, 1, 1, 0, 1, 1])], "path string, off int, len int")
    starts = spark.createDataFrame([("g", 0)], "path string, start int")
    for most in (packed.MOST, 0):
        assert {r.off for r in graph.linear_sweep(insn, starts, most).collect()} == {0, 2, 5, 6, 7}


@pytest.mark.parametrize("reach, block", [(5, 1), (3, 4), (12, 1000)])
def test_traces_against_plain(spark, reach, block):
    rng = random.Random(reach)
    edges = {(p, a, a + rng.randint(-2, 5)) for p in ("x", "y/z") for a in range(40) if rng.random() < 0.8 for _ in range(2)}
    nodes = [(p, i) for p in ("x", "y/z", "none") for i in range(40)]
    want = set()
    for p, origin in nodes:
        at = origin
        for _ in range(reach):
            ahead = min((b for q, a, b in edges if q == p and a == at), default=-1)
            if not at < ahead <= origin + reach:
                break
            at = ahead
            want.add((p, origin, at))
    got = graph.bounded_trace(spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(nodes, "path string, id int"), reach, block)
    assert rows(got, "path", "origin", "id") == want


@pytest.mark.parametrize("batch, pack", [("3", 1), ("3", 10), ("1000", 40)])
def test_packs_end_where_paths_do(spark, data, batch, pack):
    nodes, edges, n, e = data
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)

    def sizes(given):
        path, count = np.unique(given["n"]["path"], return_counts=True)
        seen = np.bincount(given["e"]["path"], minlength=path.max() + 1)[path]
        return {"path": path, "nodes": count, "edges": seen}

    try:
        got = rows(packed.in_tasks({"n": n.select("path", "id"), "e": e.select("path", "src")}, sizes, "path string, nodes long, edges long", pack), "path", "nodes", "edges")
    finally:
        spark.conf.set(key, before)
    assert got == {(g, len(own), sum(r[0] == g for r in edges)) for g, own, _pairs in by_path(nodes, edges)}


def test_edges_to_unknown_nodes_and_rows_without_a_path_are_left_out(spark):
    nodes = spark.createDataFrame([("g", 1, True, 1), ("g", 2, None, 1), (None, 3, True, 1)], NODES)
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 9), ("g", 9, 1), (None, 1, 2)], EDGES)
    for most in (10, 0):
        assert rows(graph.scc(edges, nodes, most).where("path is not null"), "path", "id", "scc") == {("g", 1, 1), ("g", 2, 2)}
        assert rows(postdom.post_dominators(nodes, edges, most), "path", "wcc", "id", "ipdom") == {("g", 1, 1, 2), ("g", 1, 2, None)}
    none = nodes.limit(0), edges.limit(0)
    assert postdom.post_dominators(*none).collect() == graph.wcc(none[1], none[0]).collect() == graph.wcc_label_propagation(none[1], none[0]).collect() == []


def test_labels_and_reach_both_ways(few):
    nodes, edges, n, e = few
    want = {(g, i, c) for g, own, pairs in by_path(nodes, edges) for i, c in brute_components(own, pairs).items()}
    assert rows(graph.wcc_label_propagation(e, n), "path", "id", "wcc") == rows(graph.wcc_label_propagation(e, n, max_nodes=0), "path", "id", "wcc") == want
    want = {(g, i) for g, own, pairs in by_path(nodes, edges) for i in reach([0], ahead_of(pairs))}
    first = n.where("id = 0").select("path", "id")
    assert rows(graph.reach_from(first, e), "path", "id") == rows(graph.reach_from(first, e, max_nodes=0), "path", "id") == want


def test_capped_labels_say_whether_they_are_final(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(9)] + [("h", i) for i in range(3)], "path string, id int")
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(8)] + [("h", 0, 1), ("h", 1, 2)], EDGES)
    got = {(r.path, r.id): (r.wcc, r.complete) for r in graph.wcc_label_propagation(edges, nodes, max_iter=2).collect()}
    assert got == {("g", i): (max(0, i - 2), False) for i in range(9)} | {("h", i): (0, True) for i in range(3)}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_spread_from_block_to_block(spark, block):
    rng = random.Random(block)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(40)}
    start = {rng.randrange(30): rng.randrange(5) for _ in range(6)}
    got = {r.id: (r.value, r.via) for r in graph.spread(spark.createDataFrame([("a/b", i, v) for i, v in start.items()], "path string, id int, value int"), spark.createDataFrame([("a/b", a, b) for a, b in pairs], EDGES), block).collect()}
    ahead = ahead_of(pairs)
    assert {i: v for i, (v, _) in got.items()} == {i: min(v for s, v in start.items() if i in reach([s], ahead)) for i in reach(list(start), ahead)}
    assert all((via, i) in pairs and got[via][0] == v for i, (v, via) in got.items() if via is not None)


LONG = 100_000


@pytest.fixture(scope="module")
def chain(spark):
    """100,000 nodes in a row, a side way over every third one, and a cycle over the last ten."""
    nodes = spark.range(LONG).selectExpr("'g' as path", "cast(id as int) as id", "id % 7 = 0 as cf", "cast(id * 37 % 11 as int) - 5 as w")
    edges = nodes.where(f"id < {LONG - 1}").selectExpr("path", "id as src", "id + 1 as dst").union(nodes.where(f"id % 3 = 0 and id < {LONG - 2}").selectExpr("path", "id", "id + 2"))
    return nodes, edges.union(spark.createDataFrame([("g", LONG - 1, LONG - 10)], EDGES))


def test_deep_graphs(spark, chain):
    nodes, edges = chain
    began = time.time()
    first = nodes.where("id = 0").select("path", "id")
    assert graph.reach_from(first, edges).count() == graph.reach_from(first, edges, max_nodes=10).count() == LONG
    for most in (packed.MOST, 10):
        assert graph.wcc_label_propagation(edges, nodes, max_nodes=most).where("wcc = 0").count() == LONG
    assert graph.scc(edges, nodes).groupBy("scc").count().where("count > 1").collect() == [(LONG - 10, 10)]
    pdt = postdom.post_dominators(nodes, edges)
    got = {r.id: r.ipdom for r in pdt.collect()}
    assert len(got) == LONG and all(got[i] == i + 1 + (i % 3 == 0) for i in range(LONG - 13))
    assert time.time() - began < 120


def test_totals_of_deep_trees(spark, chain):
    """A chain of 100,000 nodes and a comb, by contraction and in one task."""
    nodes = chain[0]
    line = nodes.selectExpr("path", "0 as wcc", "id", f"case when id < {LONG - 1} then id + 1 end as ipdom")
    comb = nodes.selectExpr("path", "0 as wcc", "id", "case when id % 2 = 0 then id + 1 when id < 99999 then id + 2 end as ipdom")
    for tree in (line, comb):
        began = time.time()
        kept = tree.join(nodes.select("path", "id", "w"), ["path", "id"])
        found = {r.id: r.total for r in postdom.subtree_totals_by_contraction(kept).collect()}
        assert time.time() - began < 60
        assert found == {r.id: r.total for r in postdom.subtree_weights(tree, nodes).collect()}
    total, want = 0, {}
    for i in range(LONG):
        total = want[i] = max(0, i * 37 % 11 - 5 + total)
    assert {r.id: r.total for r in postdom.subtree_weights(line, nodes).collect()} == want


def test_prune_and_violations_both_ways(few):
    _, _, n, e = few
    pdt = postdom.post_dominators(n, e)
    assert rows(postdom.prune(pdt, n), "path", "id") == rows(postdom.prune(pdt, n, max_nodes=0), "path", "id")
    columns = ("path", "id", "kind", "parent")
    assert rows(postdom.violations(pdt, n), *columns) == rows(postdom.violations(pdt, n, max_nodes=0), *columns)


def test_rows_once_in_blocks(spark):
    rows = [(p, k % 9000, k % 3) for p in ("a", "b/c", None) for k in range(18_000)]
    df = spark.createDataFrame(rows, "path string, src int, dst int").repartition(5)
    got = [tuple(r) for r in packed.once(df, "src", block=4000).collect()]
    assert len(got) == len(set(got)) and set(got) == set(rows)


def test_rows_of_a_path_are_shipped_as_lists(spark):
    df = spark.createDataFrame([(p, k) for p in "ab" for k in range(10_000)], "path string, id int").coalesce(1)
    sizes = [(r.path, len(r.x)) for r in packed.gathered(df, ["x"]).collect()]
    assert len(sizes) < 12 and max(n for _, n in sizes) <= packed.GATHER and sum(n for _, n in sizes) == 20_000


def test_edges_of_bytes_take_no_nested_expressions(spark):
    from seqloom.plans.derived import url_graph
    from seqloom.plans.registry import Tables

    plan = url_graph(Tables(spark, "/root/testdata/sf0.001", "html"))[1]._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("CASE WHEN") <= 4 and "% 41" not in plan
