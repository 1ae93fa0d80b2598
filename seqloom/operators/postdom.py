"""Post-dominator trees of successor graphs, and what is read off them: weights, pruning, violations.

Tables: nodes(path, id, cf, w), edges(path, src, dst), pdt(path, wcc, id, ipdom) with absolute ids and null for the exit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import blocks, packed, sequence
from seqloom.operators.graph import _block, _by_size, between_strong, between_weak, exit_edges, scc, spread, wcc
from seqloom.plans.lineage import discard, materialize

EXIT = packed.EXIT
PDT = "path string, wcc int, id int, ipdom int"
KINDS_OF_VIOLATION = ("dangling", "exclusive", "coexist")


def _trees(given: dict[str, packed.Arrays]) -> packed.Arrays:
    own = packed.Nodes(given["nodes"])
    src, dst = own.edges(given["edges"])
    last = packed.exits(src, dst, packed.strong(len(own), src, dst), own.column("cf"))
    up, part = packed.post_dominator_tree(len(own), src, dst, last), packed.weak(len(own), src, dst)
    there = np.flatnonzero(up != packed.NONE)
    above = np.where(up[there] >= 0, own.id[up[there]], EXIT)
    return {"path": own.path[there], "wcc": own.id[part[there]], "id": own.id[there], "ipdom": above}


def _with_trees(given: dict[str, packed.Arrays]) -> dict[str, packed.Arrays]:
    return given | {"tree": _trees(given)}


def post_dominators_of(contents: packed.Contents) -> DataFrame:
    """``post_dominators`` of graphs that follow from a row each."""
    return _null_exit(contents.in_tasks(_trees, PDT))


def post_dominators(nodes: DataFrame, edges: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, wcc, id, ipdom). Nodes that cannot reach the exit (a loop without control flow) are left out.

    Paths of up to ``max_nodes`` nodes go through components, strong components, exits and the tree in one task; larger ones
    by blocks of ids, where joins take what blocks leave of them, if that is still larger.
    """
    nodes = nodes.select("path", "id", F.coalesce("cf", F.lit(False)).alias("cf"))
    nodes, edges, big = _by_size(nodes, edges.select("path", "src", "dst"), max_nodes, known=False)

    small = _null_exit(packed.in_tasks({"nodes": nodes, "edges": edges}, _trees, PDT))
    if big is None:
        return small
    solvers = between_weak(max_nodes), between_strong(max_nodes), between_tree(max_nodes)
    tree = blocks.post_dominators(*big, *solvers, _block(max_nodes))
    if tree is not None:
        return small.unionByName(_null_exit(tree))
    # some loop has no way out: what leads nowhere else is left out first
    large, links = big[0], _known(*big)
    ends = exit_edges(links, scc(links, large, max_nodes), large).select("path", "src", F.lit(EXIT).alias("dst"))
    tree = post_dominators_by_meeting(links.unionByName(ends))
    return small.unionByName(wcc(links, large, max_nodes).join(tree, ["path", "id"]).select("path", "wcc", "id", "ipdom"))


def _known(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between nodes only."""
    ends = nodes.select("path", "id").distinct()
    links = edges.join(ends.withColumnRenamed("id", "src"), ["path", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["path", "dst"], "left_semi")
    return materialize(links.select("path", "src", "dst"), "links")


def between_tree(max_nodes: int) -> Callable[[DataFrame], DataFrame]:
    """The tree of a graph between blocks: in one task, or by meeting."""
    return lambda links: _tree_between(links, max_nodes)


def _tree_between(edges: DataFrame, max_nodes: int) -> DataFrame:
    """(path, id, ipdom) of edges (path, src, dst) with the exit among the ends: in one task, or by meeting."""
    big = packed.oversized(edges, max(max_nodes, 0))

    def find(given: dict[str, packed.Arrays]) -> packed.Arrays:
        links = given["edges"]
        own = packed.Nodes({"path": links["path"], "id": links["src"]})
        last = np.zeros(len(own), bool)
        last[own.find(links["path"], links["src"])[links["dst"] == EXIT]] = True
        up = packed.post_dominator_tree(len(own), *own.edges(links), last)
        there = np.flatnonzero(up != packed.NONE)
        return {"path": own.path[there], "id": own.id[there], "ipdom": np.where(up[there] >= 0, own.id[up[there]], EXIT)}

    if big is None:
        return packed.in_tasks({"edges": edges}, find, "path string, id int, ipdom int")
    small = packed.in_tasks({"edges": edges.join(big, "path", "left_anti")}, find, "path string, id int, ipdom int")
    large = post_dominators_by_meeting(edges.join(big, "path", "left_semi"))
    return small.unionByName(large.withColumn("ipdom", F.coalesce("ipdom", F.lit(EXIT))))


def _null_exit(pdt: DataFrame) -> DataFrame:
    return pdt.withColumn("ipdom", F.when(F.col("ipdom") != EXIT, F.col("ipdom")))


def post_dominators_by_meeting(edges: DataFrame, block: int = 100_000) -> DataFrame:
    """(path, id, ipdom) of edges (path, src, dst) with the exit among the ends, by joins, with a logarithm of the depth a node.

    Starts from any tree of ways to the exit. Every node with several successors moves up to where their ways in the tree
    meet, all at once, until none moves: post-dominators of a node are its ancestors all along, and in the end nothing else is.
    """
    edges = materialize(edges.where("src <> dst").distinct(), "edges")
    first = edges.where(F.col("dst") == EXIT).select("path", F.col("src").alias("id"), F.lit(0).alias("value"))
    back = edges.where(F.col("dst") != EXIT).select("path", F.col("dst").alias("src"), F.col("src").alias("dst"))
    tree = materialize(spread(first, back, block).select("path", "id", F.coalesce("via", F.lit(EXIT)).alias("up")), "tree")
    ways = edges.join(tree.select("path", F.col("id").alias("src")), ["path", "src"], "left_semi")
    ways = ways.join(tree.select("path", F.col("id").alias("dst")).unionByName(ways.select("path", F.lit(EXIT).alias("dst")).distinct()), ["path", "dst"], "left_semi")
    several = materialize(ways.groupBy("path", F.col("src").alias("id")).agg(F.collect_set("dst").alias("next")).where(F.size("next") > 1), "several")
    while True:
        lifted = _lifted(tree)
        met = _meet(several, lifted)
        new = materialize(tree.join(met, ["path", "id"], "left").select("path", "id", F.coalesce("met", "up").alias("up"), (F.col("met") != F.col("up")).alias("moved")), "tree")
        discard(tree, lifted, met)
        if new.where("moved").isEmpty():
            break
        tree = new.drop("moved")
        tree._stored = new._stored
    discard(several, edges)
    return new.select("path", "id", F.when(F.col("up") != EXIT, F.col("up")).alias("ipdom"))


def _lifted(tree: DataFrame) -> DataFrame:
    """(path, id, depth, far) of a tree (path, id, up): far has the ancestors 1, 2, 4, ... steps up, the exit as the last one there is."""
    own = materialize(tree.select("path", "id", F.array("up").alias("far"), F.col("up").alias("at"), F.lit(1).alias("depth")), "lift")
    # at and depth: where 2 ** k steps lead, or the exit, and how many steps that is
    while not own.where(F.col("at") != EXIT).isEmpty():
        above = own.select("path", F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        far = F.when(F.col("next").isNotNull(), F.concat("far", F.array("next"))).otherwise(F.col("far"))
        new = own.join(above, ["path", "at"], "left").select("path", "id", far.alias("far"), F.coalesce("next", F.lit(EXIT)).alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        new = materialize(new, "lift")
        discard(own)
        own = new
    out = own.select("path", "id", "depth", "far")
    out._stored = own._stored
    return out


def _meet(several: DataFrame, lifted: DataFrame) -> DataFrame:
    """(path, id, met): where the ways of all of ``next`` meet in the tree, two at a time."""
    top = F.array(F.lit(EXIT))
    spot = lambda name: lifted.select("path", F.col("id").alias(name), F.col("depth").alias(f"{name}_depth"), F.col("far").alias(f"{name}_far"))

    def placed(rows: DataFrame, *names: str) -> DataFrame:
        for name in names:
            rows = rows.drop(f"{name}_depth", f"{name}_far").join(spot(name), ["path", name], "left")
            rows = rows.withColumns({f"{name}_depth": F.coalesce(f"{name}_depth", F.lit(0)), f"{name}_far": F.coalesce(f"{name}_far", top)})
        return rows

    left = several.select("path", "id", F.array_sort("next").alias("next"))
    done = None
    while True:
        pairs = materialize(placed(left.select("path", "id", F.slice("next", F.lit(3), F.size("next")).alias("rest"), F.col("next")[0].alias("a"), F.col("next")[1].alias("b")), "a", "b"), "pairs")
        ended = None
        while True:
            same = F.col("a") == F.col("b")
            over = pairs.where(same).select("path", "id", "rest", F.col("a").alias("met"))
            ended = over if ended is None else ended.unionByName(over)
            pairs = pairs.where(~same)
            if pairs.isEmpty():
                break
            # the deeper one jumps up by the largest power of two that fits; level ones jump as far as they stay apart
            gap = F.abs(F.col("a_depth") - F.col("b_depth"))
            power = F.expr("cast(floor(log2(abs(a_depth - b_depth) + 0.5)) as int)")
            apart = F.expr("greatest(array_max(transform(sequence(0, size(a_far) - 1), k -> if(a_far[k] <> b_far[k], k, -1))), 0)")
            lift = lambda name: F.col(f"{name}_far")[F.when(gap == 0, apart).otherwise(power)]
            moved = pairs.select("path", "id", "rest", F.when(F.col("a_depth") >= F.col("b_depth"), lift("a")).otherwise(F.col("a")).alias("a"), F.when(F.col("b_depth") >= F.col("a_depth"), lift("b")).otherwise(F.col("b")).alias("b"))
            pairs = materialize(placed(moved, "a", "b"), "pairs")
        ended = materialize(ended, "met")
        final = ended.where(F.size("rest") == 0).select("path", "id", "met")
        done = final if done is None else done.unionByName(final)
        left = ended.where(F.size("rest") > 0).select("path", "id", F.concat(F.array("met"), "rest").alias("next"))
        if left.isEmpty():
            return materialize(done, "met")


def pdt_or_build(spark: SparkSession, stored: DataFrame | None, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Trees of ``stored`` for the paths that it has, built ones for the others."""
    if stored is None:
        return post_dominators(nodes, edges)
    have = stored.select("path").distinct()
    built = post_dominators(nodes.join(have, "path", "left_anti"), edges.join(have, "path", "left_anti"))
    return stored.select("path", "wcc", "id", "ipdom").unionByName(built)


def _ancestors(pdt: DataFrame, **flags) -> DataFrame:
    """For every node whether all of its proper ancestors have each flag (a column of ``pdt``), and its depth-1 ancestor.

    Pointers double: after k rounds they span 2 ** k ancestors. For trees of any size.
    """
    names = list(flags)
    up = pdt.select("path", "id", F.col("ipdom").alias("at"), F.when(F.col("ipdom").isNull(), F.col("id")).alias("root"), *(F.lit(True).alias(n) for n in names), F.lit(0).alias("depth"))
    own = pdt.select("path", F.col("id").alias("at"), *(flags[n].alias(f"own_{n}") for n in names))
    up = up.join(own, ["path", "at"], "left").select("path", "id", "at", "root", F.when(F.col("at").isNull(), 0).otherwise(1).alias("depth"), *(F.coalesce(f"own_{n}", F.lit(True)).alias(n) for n in names))
    up = materialize(up, "up")
    while not up.where("at is not null").isEmpty():
        far = up.select("path", F.col("id").alias("at"), F.col("at").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), *(F.col(n).alias(f"far_{n}") for n in names))
        new = up.join(far, ["path", "at"], "left").select(
            "path", "id", F.col("next").alias("at"), F.coalesce("root", "top", F.when(F.col("next").isNull(), F.col("at"))).alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), *((F.col(n) & F.coalesce(f"far_{n}", F.lit(True))).alias(n) for n in names)
        )
        new = materialize(new, "up")
        discard(up)
        up = new
    out = up.drop("at")
    out._stored = up._stored
    return out


def _tree_frames(pdt: DataFrame, nodes: DataFrame, most: int, join: bool = True) -> tuple[dict[str, DataFrame], str, DataFrame | tuple[DataFrame, DataFrame] | None]:
    """(the trees and their nodes' cf and w, which meet in the task, the type of sums, joined rows of paths of over ``most`` nodes
    or, if not ``join``, their trees and nodes)."""
    kind = {"tinyint": "long", "smallint": "long", "int": "long", "bigint": "long"}.get(nodes.schema["w"].dataType.simpleString(), "double")
    own = nodes.select("path", "id", F.coalesce("cf", F.lit(False)).alias("cf"), F.coalesce(F.col("w").cast(kind), F.lit(0).cast(kind)).alias("w"))
    tree = pdt.select("path", "wcc", "id", F.coalesce("ipdom", F.lit(EXIT)).alias("ipdom"))
    big = packed.oversized(tree, most)
    if big is None:
        return {"tree": tree, "nodes": own}, kind, None
    big = F.broadcast(materialize(big, "big"))  # over a million nodes a row
    large = tree.join(big, "path", "left_semi"), own.join(big, "path", "left_semi")
    if join:
        large = _joined(*large)
    return {"tree": tree.join(big, "path", "left_anti"), "nodes": own.join(big, "path", "left_anti")}, kind, large


def _joined(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    return materialize(_null_exit(tree.join(nodes, ["path", "id"]).select("path", "wcc", "id", "ipdom", "cf", "w")), "large")


class _Tree:
    """A pack's trees: nodes with the number of their parent, depth and top ancestor, and what is read off them."""

    def __init__(self, given: dict[str, packed.Arrays]) -> None:
        known, tree = packed.Nodes(given["nodes"]), given["tree"]
        at = known.find(tree["path"], tree["id"])
        tree = {c: x[at >= 0] for c, x in tree.items()}
        self.nodes, at = packed.Nodes(tree), at[at >= 0]
        at = at[self.nodes.first]
        self.cf, self.w, up = known.column("cf")[at], known.column("w")[at], self.nodes.column("ipdom")
        self.up = np.where(up == EXIT, EXIT, np.maximum(self.nodes.find(self.nodes.path, up), EXIT))
        self.depth, self.top, (self.positive,) = packed.over_ancestors(self.up, self.w > 0)

    def totals(self) -> np.ndarray:
        return packed.totals(self.up, self.depth, self.w)

    def rows(self, at: np.ndarray) -> packed.Arrays:
        return {"path": self.nodes.path[at], "id": self.nodes.id[at]}

    def heaviest(self, total: np.ndarray) -> np.ndarray:
        """The nodes without control flow that weigh most under their parent, the smallest id of equal ones."""
        other = np.flatnonzero(~self.cf & (self.up >= 0))
        other = other[np.lexsort((self.nodes.id[other], -total[other], self.up[other]))]
        out = np.zeros(len(self.nodes), bool)
        out[other[np.append(True, self.up[other][1:] != self.up[other][:-1])] if len(other) else other] = True
        return out


    def kept(self) -> np.ndarray:
        """Which nodes pruning keeps."""
        total = self.totals()
        can = (total > 0) & (self.cf | self.heaviest(total))
        return can & packed.over_ancestors(self.up, can)[2][0]

    def violations(self) -> tuple[np.ndarray, ...]:
        """The nodes of each of KINDS_OF_VIOLATION; no node is of two."""
        up, w = self.up, self.w
        under, parent = up >= 0, np.maximum(up, 0)
        dangling = np.flatnonzero((w > 0) & ~self.cf & ~under)
        coexist = np.flatnonzero((w > 0) & under & (w[parent] <= 0) & self.positive[parent] & self.cf[self.top])
        own = np.flatnonzero(under & ~self.cf & (w[parent] > 0) & self.positive[parent])
        own = own[np.lexsort((self.nodes.id[own], up[own]))]
        own = own[packed.records(up[own], w[own])]
        own = own[w[own] > 0]
        own = own[np.bincount(up[own], minlength=len(up) + 1)[up[own]] >= 2]
        return dangling, own, coexist


WEIGHTS = "path string, wcc int, id int, ipdom int, cf boolean, w {kind}, depth int, total {kind}"
VIOLATIONS = "path string, id int, kind string, parent int"


def _weights(given: dict[str, packed.Arrays]) -> packed.Arrays:
    tree = _Tree(given)
    own = {c: tree.nodes.column(c) for c in ("wcc", "ipdom")} | {"cf": tree.cf, "w": tree.w}
    return tree.rows(np.arange(len(tree.nodes))) | own | {"depth": tree.depth, "total": tree.totals()}


def _prune(given: dict[str, packed.Arrays]) -> packed.Arrays:
    tree = _Tree(given)
    return tree.rows(np.flatnonzero(tree.kept()))


def _violations(given: dict[str, packed.Arrays]) -> packed.Arrays:
    tree = _Tree(given)
    found = tree.violations()
    at = np.concatenate(found)
    kind = np.repeat(np.array(KINDS_OF_VIOLATION, object), [len(x) for x in found])
    return tree.rows(at) | {"kind": kind, "parent": np.where(tree.up[at] >= 0, tree.nodes.id[np.maximum(tree.up[at], 0)], EXIT)}


def _null_parent(found: DataFrame) -> DataFrame:
    return found.withColumn("parent", F.when(F.col("parent") != EXIT, F.col("parent")))


def subtree_weights_of(contents: packed.Contents) -> DataFrame:
    """``subtree_weights`` of graphs that follow from a row each, with their trees; w is long."""
    return _null_exit(contents.in_tasks(lambda given: _weights(_with_trees(given)), WEIGHTS.format(kind="long")))


def prune_of(contents: packed.Contents) -> DataFrame:
    """``prune`` of graphs that follow from a row each, with their trees."""
    return contents.in_tasks(lambda given: _prune(_with_trees(given)), "path string, id int")


def violations_of(contents: packed.Contents) -> DataFrame:
    """``violations`` of graphs that follow from a row each, with their trees."""
    return _null_parent(contents.in_tasks(lambda given: _violations(_with_trees(given)), VIOLATIONS))


def subtree_weights(pdt: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, wcc, id, ipdom, cf, w, depth, total): total = max(0, w + positive totals of the children).

    Paths of up to ``max_nodes`` nodes are each done in one task, larger ones by blocks of ids, or by contraction of their
    trees if these have most of their edges between blocks.
    """
    frames, kind, big = _tree_frames(pdt, nodes, max_nodes, join=False)

    small = _null_exit(packed.in_tasks(frames, _weights, WEIGHTS.format(kind=kind)))
    if big is None:
        return small
    large = blocks.totals(*big, kind, _block(max_nodes), max_nodes)
    if large is not None:
        return small.unionByName(_null_exit(large))
    big = _joined(*big)
    depth = _ancestors(big).select("path", "id", "depth")
    large = big.join(depth, ["path", "id"]).join(subtree_totals_by_contraction(big), ["path", "id"])
    return small.unionByName(large.select(*small.columns[:-1], F.col("total").cast(kind).alias("total")))


def subtree_totals_by_contraction(tree: DataFrame) -> DataFrame:
    """(path, id, total) of a tree (path, id, ipdom, w) of any depth, by joins.

    A node with one open child is a function of that child's total, x -> max(low, x + plus), and such functions compose. In
    each turn pointers double along all chains, the chains that end at a known node become known, and what they end under
    gets their sums; at least half of the open ends go in a turn.
    """
    none = tree.schema["w"].dataType
    zero = F.lit(0).cast(none)
    # a node's own function of what is still open below: max(0, x + plus)
    left = materialize(tree.select("path", "id", F.col("ipdom").alias("up"), F.col("w").alias("plus")), "left")
    done: list[DataFrame] = []
    while not left.isEmpty():
        below = left.where("up is not null").groupBy("path", F.col("up").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("child"))
        chain = left.join(below, ["path", "id"], "left").select("path", "id", "up", "plus", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("child")).alias("at"))
        # at: the node whose total is still to be put in, null if none; open: whether the way ends at a node with several children
        chain = chain.select("path", "id", "up", "plus", zero.alias("low"), F.col("plus").alias("add"), "at", (F.col("n") > 1).alias("open"))
        chain = materialize(chain, "chain")
        while not chain.where("at is not null").isEmpty():
            far = chain.select("path", F.col("id").alias("at"), F.col("low").alias("far_low"), F.col("add").alias("far_add"), F.col("at").alias("next"), F.col("open").alias("far_open"))
            joined = chain.join(far, ["path", "at"], "left")
            some = F.col("at").isNotNull()
            new = joined.select(
                "path", "id", "up", "plus", F.when(some, F.greatest("low", F.col("far_low") + F.col("add"))).otherwise(F.col("low")).alias("low"), F.when(some, F.col("far_add") + F.col("add")).otherwise(F.col("add")).alias("add"), F.col("next").alias("at"), F.when(some, F.col("far_open")).otherwise(F.col("open")).alias("open")
            )
            new = materialize(new, "chain")
            discard(chain)
            chain = new
        # without an open end nothing comes in from below
        known = materialize(chain.where("not open").select("path", "id", "up", F.greatest("low", "add").alias("total")), "known")
        done.append(known.select("path", "id", "total"))
        into = known.where("up is not null").groupBy("path", F.col("up").alias("id")).agg(F.sum("total").alias("more"))
        rest = chain.where("open").select("path", "id", "up", "plus").join(into, ["path", "id"], "left")
        new = materialize(rest.select("path", "id", "up", (F.col("plus") + F.coalesce("more", zero)).cast(none).alias("plus")), "left")
        discard(chain, left)
        left = new
    out = tree.select("path", "id", F.col("w").alias("total")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def prune(pdt: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id) that pruning keeps.

    A node can stay if its total is positive and it is control flow, or is the heaviest other child of its parent (the
    smallest id of equal ones) and the parent is not the exit. It stays if all its ancestors can stay too.
    """
    frames, _, big = _tree_frames(pdt, nodes, max_nodes)

    small = packed.in_tasks(frames, _prune, "path string, id int")
    return small if big is None else small.unionByName(prune_by_joins(big))


def prune_by_joins(tree: DataFrame) -> DataFrame:
    """The same of a tree (path, id, ipdom, cf, w) of any size."""
    tree = tree.join(subtree_totals_by_contraction(tree), ["path", "id"])
    best = tree.where("not cf and ipdom is not null").groupBy("path", "ipdom").agg(F.min(F.struct(-F.col("total"), "id")).alias("best")).select("path", "ipdom", F.col("best.id").alias("best"))
    can = tree.join(best, ["path", "ipdom"], "left").withColumn("can", (F.col("total") > 0) & (F.col("cf") | F.coalesce(F.col("id") == F.col("best"), F.lit(False))))
    can = materialize(can, "can")
    return can.where("can").join(_ancestors(can, can=F.col("can")).where("can").select("path", "id"), ["path", "id"], "left_semi").select("path", "id")


def violations(pdt: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id, kind, parent) on raw scores: dangling, exclusive and coexist.

    Exclusive depends on the order of ids: a sibling counts if it is at least the largest before it, and two such are needed.
    """
    frames, _, big = _tree_frames(pdt, nodes, max_nodes)

    small = _null_parent(packed.in_tasks(frames, _violations, VIOLATIONS))
    return small if big is None else small.unionByName(violations_by_joins(big))


def violations_by_joins(tree: DataFrame) -> DataFrame:
    """The same of a tree (path, id, ipdom, cf, w) of any size."""
    above = _ancestors(tree, positive=F.col("w") > 0)
    parent = tree.select("path", F.col("id").alias("ipdom"), F.col("w").alias("pw")).join(above.select("path", F.col("id").alias("ipdom"), F.col("positive").alias("ppos")), ["path", "ipdom"])
    root = tree.select("path", F.col("id").alias("root"), F.col("cf").alias("root_cf"))
    rows = materialize(tree.join(parent, ["path", "ipdom"], "left").join(above.select("path", "id", "root"), ["path", "id"]).join(root, ["path", "root"]), "rows")
    discard(above)
    dangling = rows.where("w > 0 and not cf and ipdom is null").select("path", "id", F.lit("dangling").alias("kind"), F.col("ipdom").alias("parent"))
    records = running_records(rows.where("ipdom is not null and not cf and pw > 0 and ppos"), ["path", "ipdom"], "id", "w").where("record and w > 0")
    several = records.groupBy("path", "ipdom").agg(F.count("*").alias("n")).where("n >= 2").select("path", "ipdom")
    exclusive = records.join(several, ["path", "ipdom"], "left_semi").select("path", "id", F.lit("exclusive").alias("kind"), F.col("ipdom").alias("parent"))
    coexist = rows.where("w > 0 and ipdom is not null and pw <= 0 and ppos and root_cf").select("path", "id", F.lit("coexist").alias("kind"), F.col("ipdom").alias("parent"))
    return dangling.unionByName(exclusive).unionByName(coexist)


def judge(pdt: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id, kept, kind): the nodes that pruning keeps and those of a violation (else null), from one look at each tree."""
    frames, _, big = _tree_frames(pdt, nodes, max_nodes)

    def find(given: dict[str, packed.Arrays]) -> packed.Arrays:
        tree = _Tree(given)
        kept, kind = tree.kept(), np.full(len(tree.nodes), None, object)
        for name, at in zip(KINDS_OF_VIOLATION, tree.violations(), strict=True):
            kind[at] = name
        at = np.flatnonzero(kept | (kind != None))  # noqa: E711
        return tree.rows(at) | {"kept": kept[at], "kind": kind[at]}

    small = packed.in_tasks(frames, find, "path string, id int, kept boolean, kind string")
    if big is None:
        return small
    large = prune_by_joins(big).withColumn("kept", F.lit(True)).join(violations_by_joins(big).select("path", "id", "kind"), ["path", "id"], "full")
    return small.unionByName(large.select("path", "id", F.coalesce("kept", F.lit(False)).alias("kept"), "kind"))


def judged(given: dict[str, packed.Arrays]) -> tuple[packed.Nodes, np.ndarray, tuple[np.ndarray, ...]]:
    """(the nodes of the trees of a pack's graphs, which of them pruning keeps, those of each of KINDS_OF_VIOLATION)."""
    tree = _Tree(_with_trees(given))
    return tree.nodes, tree.kept(), tree.violations()


def running_records(df: DataFrame, keys: list[str], order: str, value: str, block: int = sequence.BLOCK) -> DataFrame:
    """``record``: whether the value is at least the largest before it in the order, at the start 0."""
    out = sequence.running_max(df, keys, [order], value, "_before", block)
    return out.withColumn("record", F.col(value) >= F.greatest(F.lit(0), F.coalesce("_before", F.lit(0)))).drop("_before")


def enrich_violations(viol: DataFrame, insn: DataFrame) -> DataFrame:
    """Violations with their own instruction's text and their parent's (null for the exit)."""
    text = insn.select("path", F.col("off").alias("id"), "text")
    return viol.join(text, ["path", "id"]).join(text.select("path", F.col("id").alias("parent"), F.col("text").alias("parent_text")), ["path", "parent"], "left")


def reclassify(viol: DataFrame) -> DataFrame:
    """Kinds after a look at the text: lock and wait drop out, a dangling nop too, a coexist at or under a nop is ``nop``."""
    own, above = F.ltrim("text"), F.ltrim(F.coalesce("parent_text", F.lit("")))
    prefix = own.startswith("lock") | own.startswith("wait")
    nop, nop_above = own.startswith("nop"), above.startswith("nop")
    kept = viol.where(~prefix & ~((F.col("kind") == "dangling") & nop))
    return kept.withColumn("kind", F.when((F.col("kind") == "coexist") & (nop | nop_above), "nop").otherwise(F.col("kind")))
