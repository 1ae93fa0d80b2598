"""Graphs of successor tables: components, reachability, traces, sweeps. Tables: nodes(path, id, ...), edges(path, src, dst)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import blocks, packed, sequence
from seqloom.plans.lineage import connected_components, discard, materialize

ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def edges_from(insn: DataFrame, succ: str = "succ") -> DataFrame:
    return adjacency(insn.select("path", F.col("off").alias("src"), F.explode(succ).alias("dst")).where("dst is not null"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge once."""
    return packed.once(edges.select("path", "src", "dst"), "src")


def union_nodes(*marked: DataFrame) -> DataFrame:
    """(path, id) of the nodes that any of the tables (path, id) marks."""
    out = marked[0].select("path", "id")
    for df in marked[1:]:
        out = out.union(df.select("path", "id"))
    return packed.once(out, "id")


WCC, SCC = "path string, id int, wcc int", "path string, id int, scc int"


def _weak(given: dict[str, packed.Arrays]) -> packed.Arrays:
    own = packed.Nodes(given["nodes"])
    return {"path": own.path, "id": own.id, "wcc": own.id[packed.weak(len(own), *own.edges(given["edges"]))]}


def _strong(given: dict[str, packed.Arrays]) -> packed.Arrays:
    own = packed.Nodes(given["nodes"])
    return {"path": own.path, "id": own.id, "scc": own.id[packed.strong(len(own), *own.edges(given["edges"]))]}


def wcc_of(contents: packed.Contents) -> DataFrame:
    """``wcc`` of graphs that follow from a row each."""
    return contents.in_tasks(_weak, WCC)


def scc_of(contents: packed.Contents) -> DataFrame:
    """``scc`` of graphs that follow from a row each."""
    return contents.in_tasks(_strong, SCC)


def wcc(edges: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id, wcc): weakly connected components, named by their smallest node.

    A path of up to ``max_nodes`` nodes is done in one task, a larger one by blocks of ids; star contraction takes what blocks
    leave of it, if that is still larger.
    """
    nodes, edges, big = _by_size(nodes.select("path", "id"), edges.select("path", "src", "dst"), max_nodes, known=False)
    small = packed.in_tasks({"nodes": nodes, "edges": edges}, _weak, WCC)
    return small if big is None else small.unionByName(blocks.weak(*big, between_weak(max_nodes), _block(max_nodes)))


def between_weak(max_nodes: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Components of a graph between blocks: in one task, or by stars."""

    def solve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        nodes, edges, rest = _by_size(nodes, edges, max_nodes)
        found = wcc(edges, nodes)
        return found if rest is None else found.unionByName(wcc_by_stars(rest[1], rest[0]))

    return solve


def between_strong(max_nodes: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Strong components of a graph between blocks: in one task, or by colours."""

    def solve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        nodes, edges, rest = _by_size(nodes, edges, max_nodes)
        found = scc(edges, nodes)
        return found if rest is None else found.unionByName(scc_by_colours(rest[1], rest[0]))

    return solve


def _block(max_nodes: int) -> int:
    return min(blocks.BLOCK, max(max_nodes, 4))


def wcc_by_stars(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same by joins only, for graphs of any size."""
    ends = edges.select(F.struct("path", F.col("src").alias("id")).alias("a"), F.struct("path", F.col("dst").alias("id")).alias("b"))
    found = connected_components(ends).select(F.col("node.path").alias("path"), F.col("node.id").alias("id"), F.col("component.id").alias("wcc"))
    return nodes.select("path", "id").join(found, ["path", "id"], "left").select("path", "id", F.coalesce("wcc", "id").alias("wcc"))


def _by_size(nodes: DataFrame, edges: DataFrame, most: int, known: bool = True) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(nodes, edges) of paths of at most ``most`` nodes, and those of the others, if any; ``known``: with edges between nodes only."""
    big = packed.oversized(nodes, most)
    if big is None:
        return nodes, edges, None
    big = materialize(big, "big")
    large = nodes.join(F.broadcast(big), "path", "left_semi")  # over a million nodes a row
    if not known:
        links = edges.join(F.broadcast(big), "path", "left_semi")
        return nodes.join(F.broadcast(big), "path", "left_anti"), edges.join(F.broadcast(big), "path", "left_anti"), (large, links)
    ends = large.select("path", "id").distinct()
    links = edges.join(ends.withColumnRenamed("id", "src"), ["path", "src"], "left_semi").join(ends.withColumnRenamed("id", "dst"), ["path", "dst"], "left_semi")
    return nodes.join(big, "path", "left_anti"), edges.join(big, "path", "left_anti"), (large, links.select(*edges.columns))


def spread(start: DataFrame, edges: DataFrame, block: int = 100_000) -> DataFrame:
    """(path, id, value, via): the least value of ``start`` (path, id, value) that reaches each node along the edges, and the
    node before it on that way (null at the start).

    Nodes are dealt in blocks of ``block`` neighbouring ids. A block takes what it hears through all of its own edges at
    once, so rounds count the crossings between blocks on a way, not its nodes; blocks that hear nothing rest.
    """
    block_of = lambda c: F.floor(F.col(c) / block)
    key = lambda c: F.concat_ws("/", block_of(c), "path")
    links = materialize(edges.where("path is not null").select(key("src").alias("path"), "src", "dst").distinct(), "links")
    heard = start.where("path is not null").groupBy("path", "id").agg(F.min("value").alias("value")).withColumn("via", F.lit(packed.NONE))
    heard, state = materialize(heard, "heard"), None

    def tell(given: dict[str, packed.Arrays]) -> packed.Arrays:
        return _tell(given, block)

    while not heard.isEmpty():
        awake = heard.select(key("id").alias("path")).distinct()
        frames = {"heard": heard.select(key("id").alias("path"), "id", "value", "via"), "edges": links.join(awake, "path", "left_semi")}
        if state is not None:
            frames["known"] = state.select(key("id").alias("path"), "id", "value").join(awake, "path", "left_semi")
        told = packed.in_tasks(frames, tell, "path string, id int, value int, via int, outside boolean")
        told = materialize(told.withColumn("path", F.expr("substr(path, instr(path, '/') + 1)")), "told")
        inside = told.where("not outside").select("path", "id", "value", "via")
        new = inside if state is None else state.unionByName(inside)
        new = materialize(new.groupBy("path", "id").agg(F.min(F.struct("value", "via")).alias("own")).select("path", "id", "own.value", "own.via"), "state")
        known = new.select("path", "id", F.col("value").alias("old"))
        outside = told.where("outside").groupBy("path", "id").agg(F.min(F.struct("value", "via")).alias("own")).select("path", "id", "own.value", "own.via")
        better = materialize(outside.join(known, ["path", "id"], "left").where("old is null or value < old").select("path", "id", "value", "via"), "heard")
        discard(heard, state, told)
        state, heard = new, better
    discard(heard, links)
    if state is None:
        return start.select("path", "id", F.col("value").cast("int").alias("value"), F.lit(None).cast("int").alias("via"))
    out = state.withColumn("via", F.when(F.col("via") != packed.NONE, F.col("via")))
    out._stored = state._stored
    return out


def _tell(given: dict[str, packed.Arrays], block: int) -> packed.Arrays:
    """What is new in some blocks, and what they tell others: values spread in rising order, so that each node is told once."""
    heard, edges = given["heard"], given["edges"]
    ends = [(heard["path"], heard["id"]), (edges["path"], edges["src"])]
    within = edges["dst"] // block == edges["src"] // block
    ends.append((edges["path"][within], edges["dst"][within]))
    nodes = packed.Nodes({"path": np.concatenate([p for p, _ in ends]), "id": np.concatenate([i for _, i in ends])})
    value = np.full(len(nodes), np.iinfo(np.int64).max)
    if "known" in given:
        at = nodes.find(given["known"]["path"], given["known"]["id"])
        value[at[at >= 0]] = given["known"]["value"][at >= 0]
    values, via, moved = value.tolist(), [packed.NONE] * len(nodes), []
    src = nodes.find(edges["path"], edges["src"])
    start, ahead = packed.neighbours(len(nodes), src[within], nodes.find(edges["path"][within], edges["dst"][within]))
    at = nodes.find(heard["path"], heard["id"])
    for k in np.lexsort((at, heard["value"])).tolist():
        v, x = int(at[k]), int(heard["value"][k])
        if x >= values[v]:
            continue
        values[v], via[v], left = x, int(heard["via"][k]), [v]
        moved.append(v)
        while left:
            v = left.pop()
            for u in ahead[start[v] : start[v + 1]]:
                if x < values[u]:
                    values[u], via[u] = x, int(nodes.id[v])
                    moved.append(u)
                    left.append(u)
    new, via, values = np.array(moved, np.int64), np.array(via, np.int64), np.array(values, np.int64)
    fresh = np.zeros(len(nodes), bool)
    fresh[new] = True
    out = ~within & fresh[src]
    return {
        "path": np.concatenate([nodes.path[new], edges["path"][out]]),
        "id": np.concatenate([nodes.id[new], edges["dst"][out]]),
        "value": np.concatenate([values[new], values[src[out]]]),
        "via": np.concatenate([via[new], edges["src"][out]]),
        "outside": np.repeat([False, True], [len(new), int(out.sum())]),
    }


def wcc_label_propagation(edges: DataFrame, nodes: DataFrame, max_iter: int | None = None, max_nodes: int = packed.MOST) -> DataFrame:
    """The same by minimum labels in both directions, until no label moves.

    Without ``max_iter`` nothing is left of the steps: graphs hook and jump in one task, larger ones block by block. With
    ``max_iter`` labels take that many steps of one edge at most; a column ``complete`` tells whether the path's labels are final.
    """
    if max_iter is None:
        return wcc(edges, nodes, max_nodes)
    both = materialize(edges.select("path", "src", "dst").union(edges.select("path", F.col("dst"), F.col("src"))).distinct(), "both")
    labels = materialize(nodes.select("path", "id", F.col("id").alias("wcc")), "labels")
    heard = lambda own: both.join(own.select("path", F.col("id").alias("src"), "wcc"), ["path", "src"]).groupBy("path", F.col("dst").alias("id")).agg(F.min("wcc").alias("low"))
    for _ in range(max_iter):
        new = materialize(labels.join(heard(labels), ["path", "id"], "left").select("path", "id", F.least("wcc", "low").alias("wcc"), (F.col("low") < F.col("wcc")).alias("moved")), "labels")
        discard(labels)
        labels, still = new.drop("moved"), new.where("moved").isEmpty()
        labels._stored = new._stored
        if still:
            break
    moving = labels.join(heard(labels), ["path", "id"]).where("low < wcc").select("path").distinct().withColumn("moving", F.lit(True))
    return labels.join(moving, "path", "left").select("path", "id", "wcc", F.col("moving").isNull().alias("complete"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("path", "wcc").agg(F.count("*").alias("size"))


def component_summary(components: DataFrame) -> DataFrame:
    return component_sizes(components).groupBy("path").agg(F.count("*").alias("components"), F.max("size").alias("largest"))


def component_nodes(components: DataFrame) -> DataFrame:
    """The sorted nodes of each component; one row per component is for output, no operator here reads it."""
    return components.groupBy("path", "wcc").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _reached(given: dict[str, packed.Arrays]) -> packed.Arrays:
    first, links = given["entries"], given["edges"]
    nodes = packed.Nodes({"path": np.concatenate([first["path"], links["path"], links["path"]]), "id": np.concatenate([first["id"], links["src"], links["dst"]])})
    seen = packed.reached(len(nodes), *nodes.edges(links), nodes.find(first["path"], first["id"]))
    return {"path": nodes.path[seen], "id": nodes.id[seen]}


def between_reach(max_nodes: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Reach in a graph between blocks: in one task, or from block to block."""

    def solve(first: DataFrame, links: DataFrame) -> DataFrame:
        most = packed.oversized(first.select("path").unionByName(links.select("path")), max_nodes)
        if most is None:
            return packed.in_tasks({"entries": first, "edges": links}, _reached, "path string, id int")
        few = packed.in_tasks({"entries": first.join(most, "path", "left_anti"), "edges": links.join(most, "path", "left_anti")}, _reached, "path string, id int")
        return few.unionByName(spread(first.join(most, "path", "left_semi").withColumn("value", F.lit(0)), links.join(most, "path", "left_semi")).select("path", "id"))

    return solve


def reach_from(entries: DataFrame, edges: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id) of all nodes that the entries (path, id) reach, themselves included.

    Graphs of up to ``max_nodes`` entries and edges are searched in one task, larger ones block by block; depth costs nothing.
    """
    entries, edges = entries.select("path", "id").distinct(), edges.select("path", "src", "dst")
    big = packed.oversized(entries.select("path").unionByName(edges.select("path")), max_nodes)

    large = None
    if big is not None:
        big = materialize(big, "big")
        big = F.broadcast(big)  # over a million edges a row

        large = blocks.reached(entries.join(big, "path", "left_semi"), edges.join(big, "path", "left_semi"), between_reach(max_nodes), _block(max_nodes))
        entries, edges = entries.join(big, "path", "left_anti"), edges.join(big, "path", "left_anti")
    small = packed.in_tasks({"entries": entries, "edges": edges}, _reached, "path string, id int")
    return small if large is None else small.unionByName(large)


def per_component(df: DataFrame, fn: Callable[[list[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` of the rows of each component; ``df`` starts with path and wcc. Callers bound the size of a component.

    Components are dealt by a hash and sorted, so that a task runs through many of them, one in memory at a time.
    """
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [ARROW[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key and own:
                    out += fn(own)
                    own = []
                key = row[:2]
                own.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))
                out = []
        out = list(fn(own)) if own else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    return df.repartition("path", "wcc").sortWithinPartitions("path", "wcc").mapInArrow(run, schema)


def scc(edges: DataFrame, nodes: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, id, scc): strongly connected components, named by their smallest node.

    A path of up to ``max_nodes`` nodes is done in one task, a larger one by blocks of ids; colours take what blocks leave of
    it, if that is still larger.
    """
    nodes, edges, big = _by_size(nodes.select("path", "id"), edges.select("path", "src", "dst"), max_nodes, known=False)
    small = packed.in_tasks({"nodes": nodes, "edges": edges}, _strong, SCC)
    return small if big is None else small.unionByName(blocks.strong(*big, between_strong(max_nodes), _block(max_nodes)))


def scc_by_colours(edges: DataFrame, nodes: DataFrame, block: int = 100_000) -> DataFrame:
    """The same for components of any size, from block to block.

    Colours spread forward as minima; a node that keeps its own colour is a root, and what reaches it backwards inside
    the colour is its component. Found nodes go and the rest is coloured again; nodes without an edge on one side are
    components of their own and go first. Each turn finds a component of every colour, so it ends.
    """
    left, links = nodes.select("path", "id").distinct(), edges.select("path", "src", "dst").where("src <> dst").distinct()
    left, done = materialize(left, "left"), []

    def inner(own: DataFrame) -> DataFrame:
        return links.join(own.withColumnRenamed("id", "src"), ["path", "src"], "left_semi").join(own.withColumnRenamed("id", "dst"), ["path", "dst"], "left_semi").select("path", "src", "dst")

    while not left.isEmpty():
        links = materialize(links, "links")
        core = links.select("path", F.col("src").alias("id")).intersect(links.select("path", F.col("dst").alias("id")))
        single = materialize(left.join(core, ["path", "id"], "left_anti").select("path", "id", F.col("id").alias("scc")), "scc")
        done.append(single)
        left = materialize(left.join(core, ["path", "id"], "left_semi"), "left")
        links = inner(left)
        if not single.isEmpty():
            continue
        colour = spread(left.withColumn("value", F.col("id")), links, block).select("path", "id", F.col("value").alias("colour"))
        own = links.join(colour.select("path", F.col("id").alias("src"), F.col("colour").alias("c1")), ["path", "src"]).join(colour.select("path", F.col("id").alias("dst"), F.col("colour").alias("c2")), ["path", "dst"]).where("c1 = c2")
        roots = colour.where("id = colour").select("path", "id", F.lit(0).alias("value"))
        back = spread(roots, own.select("path", F.col("dst").alias("src"), F.col("src").alias("dst")), block).select("path", "id")
        found = materialize(back.join(colour, ["path", "id"]).select("path", "id", F.col("colour").alias("scc")), "scc")
        done.append(found)
        left = materialize(left.join(found, ["path", "id"], "left_anti"), "left")
        links = inner(left)
    out = nodes.select("path", "id", F.col("id").alias("scc")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def exit_edges(edges: DataFrame, components: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, src) of edges to the virtual exit: from every strong component that no edge leaves; a single node connects
    itself, a larger component its control-flow nodes only. ``nodes`` has cf."""
    tag = components.select("path", "id", "scc")
    leaving = edges.join(tag.select("path", F.col("id").alias("src"), F.col("scc").alias("s")), ["path", "src"]).join(tag.select("path", F.col("id").alias("dst"), F.col("scc").alias("t")), ["path", "dst"]).where("s <> t")
    last = tag.join(leaving.select("path", F.col("s").alias("scc")).distinct(), ["path", "scc"], "left_anti")
    sized = tag.groupBy("path", "scc").agg(F.count("*").alias("size"))
    return last.join(sized, ["path", "scc"]).join(nodes.select("path", "id", "cf"), ["path", "id"]).where("size = 1 or cf").select("path", F.col("id").alias("src"))


def bounded_trace(edges: DataFrame, nodes: DataFrame, reach: int, block: int = 100_000) -> DataFrame:
    """(path, origin, id): nodes on the chain of first successors from each origin, while they lie after it and within ``reach``.

    Origins are dealt in blocks of ids, each with the edges up to ``reach`` past its end; a task takes a step from all of its
    origins at once.
    """
    key = lambda c: F.concat_ws("/", c, "path")
    step = edges.where("path is not null")
    blocks = F.sequence(F.floor((F.col("src") - reach) / block), F.floor(F.col("src") / block))
    ahead = step.withColumn("_block", F.explode(blocks)).select(key(F.col("_block")).alias("path"), "src", "dst")
    origins = nodes.where("path is not null").select(key(F.floor(F.col("id") / block)).alias("path"), "id").distinct()

    def walk(given: dict[str, packed.Arrays]) -> packed.Arrays:
        own, links = given["origins"], given["edges"]
        order = np.lexsort((links["dst"], links["src"], links["path"]))
        links = {c: x[order] for c, x in links.items()}
        src = packed.Nodes({"path": links["path"], "id": links["src"]})
        dst = links["dst"][src.first]
        path, origin, at = own["path"], own["id"], own["id"]
        found = []
        for _ in range(reach):
            k = src.find(path, at)
            go = k >= 0
            path, origin, last, at = path[go], origin[go], at[go], dst[k[go]] if len(dst) else at[go]
            near = (at <= origin + reach) & (at > last)
            path, origin, at = path[near], origin[near], at[near]
            if not len(at):
                break
            found.append((path, origin, at))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return dict(zip(("path", "origin", "id"), columns, strict=True))

    out = packed.in_tasks({"origins": origins, "edges": ahead}, walk, "path string, origin int, id int")
    return out.withColumn("path", F.expr("substr(path, instr(path, '/') + 1)"))


def window_closure(edges: DataFrame, size: int) -> DataFrame:
    """(path, win, src, dst): what reaches what by edges that stay inside each window of ``size`` offsets.

    A window is a square matrix of bits; a task closes the windows it holds by squaring them, many at a time. Windows are dealt
    in blocks of about 100,000 offsets.
    """
    win = F.floor(F.col("src") / size)
    block = F.floor(F.col("src") / (size * max(1, packed.PACK // size)))
    own = edges.where((win == F.floor(F.col("dst") / size)) & F.col("path").isNotNull()).select(F.concat_ws("/", block, "path").alias("path"), "src", "dst")

    out = packed.in_tasks({"edges": own}, _closing(size), CLOSURE)
    return out.withColumn("path", F.expr("substr(path, instr(path, '/') + 1)"))


CLOSURE = "path string, win long, src int, dst int"


def window_closure_of(contents: packed.Contents, size: int) -> DataFrame:
    """``window_closure`` of graphs that follow from a row each."""
    close = _closing(size)

    def inside(given: dict[str, packed.Arrays]) -> packed.Arrays:
        edges = given["edges"]
        own = edges["src"] // size == edges["dst"] // size
        return close({"edges": {c: x[own] for c, x in edges.items()}})

    return contents.in_tasks(inside, CLOSURE)


def _closing(size: int) -> Callable[[dict[str, packed.Arrays]], packed.Arrays]:
    def close(given: dict[str, packed.Arrays]) -> packed.Arrays:
        path, src, dst = (given["edges"][c] for c in ("path", "src", "dst"))
        keys, first, at = np.unique(packed.keys_of(path, src // size), return_index=True, return_inverse=True)
        outs = []
        step = max(1, (1 << 26) // (size * size))
        for k in range(0, len(keys), step):
            here = np.flatnonzero((at >= k) & (at < k + step))
            known = np.zeros((min(step, len(keys) - k), size, size), np.float32)
            known[at[here] - k, src[here] % size, dst[here] % size] = 1
            n = -1
            while n != (n := int(known.sum())):
                known = np.minimum(known + known @ known, 1)
            outs.append(np.argwhere(known > 0) + [k, 0, 0])
        found = np.concatenate(outs) if outs else np.empty((0, 3), np.int64)
        base = np.zeros(len(keys), np.int64)
        base[at] = src // size * size
        return {"path": path[first][found[:, 0]], "win": base[found[:, 0]] // size, "src": base[found[:, 0]] + found[:, 1], "dst": base[found[:, 0]] + found[:, 2]}

    return close


def component_window(components: DataFrame, left: int, right: int) -> DataFrame:
    """(path, id, delta, same) for neighbours from -left to right: whether they are in the node's component; outside is false."""
    pairs = components.select("path", "id", "wcc", F.explode(F.sequence(F.lit(-left), F.lit(right))).alias("delta")).withColumn("other", F.col("id") + F.col("delta"))
    near = components.select("path", F.col("id").alias("other"), F.col("wcc").alias("theirs"))
    return pairs.join(near, ["path", "other"], "left").select("path", "id", "delta", F.coalesce(F.col("wcc") == F.col("theirs"), F.lit(False)).alias("same"))


def linear_sweep(insn: DataFrame, starts: DataFrame, max_nodes: int = packed.MOST) -> DataFrame:
    """(path, off) that a sweep from the starts (path, start) meets: off + len, or one byte on where the decode failed.

    Files of up to ``max_nodes`` instructions are swept in one task each, larger ones by blocks.
    """
    known = insn.select("path", "off")
    big = packed.oversized(insn, max_nodes)
    if big is not None:
        big = materialize(big, "big")
        small = linear_sweep(insn.join(big, "path", "left_anti"), starts.join(big, "path", "left_anti"), max_nodes)
        insn, starts = insn.join(big, "path", "left_semi"), starts.join(big, "path", "left_semi")
        known = insn.select("path", "off")
    else:

        def find(given: dict[str, packed.Arrays]) -> packed.Arrays:
            own = packed.Nodes({"path": given["insn"]["path"], "id": given["insn"]["off"]})
            src, dst = own.edges({"path": given["insn"]["path"], "src": given["insn"]["off"], "dst": given["insn"]["off"] + given["insn"]["step"]})
            first = own.find(given["starts"]["path"], given["starts"]["start"])
            seen = packed.reached(len(own), src, dst, np.unique(first[first >= 0]))
            return {"path": own.path[seen], "off": own.id[seen]}

        step = insn.select("path", "off", F.greatest("len", F.lit(1)).alias("step"))
        return packed.in_tasks({"insn": step, "starts": starts.where("start is not null").select("path", "start")}, find, "path string, off int")
    first = starts.select("path", F.col("start").alias("off")).join(known, ["path", "off"], "left_semi").withColumnRenamed("off", "id")
    steps = insn.select("path", F.col("off").alias("src"), (F.col("off") + F.greatest("len", F.lit(1))).alias("dst"))
    # a step past the last instruction leads nowhere
    return small.unionByName(reach_from(first, steps, max_nodes).withColumnRenamed("id", "off").join(known, ["path", "off"], "left_semi"))


def gather_neighbours(nodes: DataFrame, links: DataFrame, feature: str) -> DataFrame:
    """(path, id, class, value): the feature of each linked node (path, id, class, other); a missing one is 0."""
    near = nodes.select("path", F.col("id").alias("other"), F.col(feature).alias("value"))
    return links.join(near, ["path", "other"], "left").select("path", "id", "class", F.coalesce("value", F.lit(0)).alias("value"))


def window_neighbours(df: DataFrame, key: str, order: str, value: str, left: int, right: int, block: int = sequence.BLOCK) -> DataFrame:
    """``near``: the values from ``left`` rows before to ``right`` rows after each row of its key."""
    return sequence.near(df, [key], [order], left, right, {"near": F.collect_list(value)}, block)
