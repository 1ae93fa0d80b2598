"""Graphs of any size, a block of neighbouring ids in a task: what a block is to the others is a small graph of the ends of
edges between blocks, which is solved as a graph of its own, and each block is done with the answer.

Paths of tables here are ``block/path``. A graph whose edges mostly stay near takes two or three looks at its blocks, however
deep it is. Results are exact for any graph: with many crossing edges the graph between blocks is larger, no edge is left out,
and when it does not get smaller the caller's joins take it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import packed
from seqloom.operators.packed import EXIT, NONE, Arrays, Dealt, Laid, Nodes
from seqloom.plans.lineage import materialize

Base = Dealt | Laid
Look = Callable[[dict[str, Arrays]], Arrays]

BLOCK = 250_000  # neighbouring ids of a path that one task takes
PAIRS = 64  # ends of a block that are followed one by one; with more, the edges between them stay as they are


def key(c: str, block: int) -> Column:
    return F.concat_ws("/", F.floor(F.col(c) / block), "path")


def by_block(df: DataFrame, c: str, block: int) -> DataFrame:
    """The rows under the block of their column ``c``."""
    return df.where("path is not null").select(key(c, block).alias("path"), *(x for x in df.columns if x != "path"))


def of_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.expr("substr(path, instr(path, '/') + 1)"))


def dealt(edges: DataFrame, block: int, **more: DataFrame) -> Dealt:
    """Edges by the block of their start, ``into`` by the one of their end if it is another, tables (path, id, ...) by their id's."""
    frames = {name: by_block(df, "id", block) for name, df in more.items()}
    edges = edges.select("path", "src", "dst").where("src is not null and dst is not null")
    frames["edges"] = by_block(edges, "src", block)
    frames["into"] = by_block(edges.where(F.floor(F.col("src") / block) != F.floor(F.col("dst") / block)).select("path", F.col("dst").alias("id")), "id", block)
    return packed.dealt(frames).stored("blocks")


def laid(rows: DataFrame, decode, block: int) -> Laid:
    """Blocks whose ``nodes`` and ``edges`` follow from a row each (``packed.Laid``): a look at them finds the edges between blocks."""
    base = Laid(rows, decode, block)

    def leaving(given: dict[str, Arrays]) -> Arrays:
        return split(given, block)[1]

    across = materialize(of_path(base.in_tasks(leaving, "path string, src int, dst int")), "across")
    base = base.plus({"into": by_block(across.select("path", F.col("dst").alias("id")), "id", block)})
    return Laid(base.rows, decode, block, base.names, across, across.where("dst < src").isEmpty())


def split(given: dict[str, Arrays], block: int) -> tuple[Arrays, Arrays]:
    """(edges inside blocks, edges that leave them)."""
    edges = given["edges"]
    src, dst = edges["src"], edges["dst"]
    low = int(src.min()) // block * block if len(src) else 0
    if len(src) and src.max() < low + block:
        within = (dst >= low) & (dst < low + block)
    else:
        within = src // block == dst // block
    return {c: x[within] for c, x in edges.items()}, {c: x[~within] for c, x in edges.items()}


def joined(*parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def weak(nodes: DataFrame, edges: DataFrame, solve, block: int = BLOCK) -> DataFrame:
    """(path, id, wcc) of weakly connected components; ``solve`` (edges, nodes) does the graph between blocks.

    The ends of crossing edges hang on the smallest node that they are connected with in their block.
    """
    base, name = weak_of(dealt(edges, block, nodes=nodes.select("path", "id")), solve, block)
    return of_path(packed.in_tasks(base, name, "path string, id int, wcc int"))


def weak_of(base: Base, solve, block: int) -> tuple[Base, Look]:
    """(blocks with what they need, the look at a block that gives path, id, wcc)."""
    parts = by_block(weak_ends(base, solve, block), "id", block)

    def name(given: dict[str, Arrays]) -> Arrays:
        own = Nodes(given["nodes"])
        return {"path": own.path, "id": own.id, "wcc": _named(own, given, block)}

    return base.plus({"parts": parts}), name


def weak_ends(base: Base, solve, block: int) -> DataFrame:
    """(path, id, wcc) of the ends of crossing edges and the nodes that they hang on."""

    def ends(given: dict[str, Arrays]) -> Arrays:
        own = Nodes(given["nodes"])
        inside, across = split(given, block)
        label = packed.weak(len(own), *own.edges(inside))
        src, into = own.find(across["path"], across["src"]), own.find(given["into"]["path"], given["into"]["id"])
        known, at = src >= 0, np.unique(np.concatenate([src[src >= 0], into[into >= 0]]))
        path, a, b = joined((own.path[at], own.id[at], own.id[label[at]]), (across["path"][known], across["src"][known], across["dst"][known]))
        return {"path": path, "src": a, "dst": b, "node": np.repeat([True, False], [len(at), int(known.sum())])}

    found = materialize(of_path(packed.in_tasks(base, ends, "path string, src int, dst int, node boolean")), "ends")
    some = found.where("node").select("path", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return materialize(solve(found.select("path", "src", "dst"), some), "solved")


def _named(own: Nodes, given: dict[str, Arrays], block: int) -> np.ndarray:
    """The component of every node, given ``parts`` of ``weak_ends``."""
    best, parts = own.id.copy(), given["parts"]
    at = own.find(parts["path"], parts["id"])
    best[at[at >= 0]] = parts["wcc"][at >= 0]
    return best[packed.weak(len(own), *own.edges(split(given, block)[0]))]


def reached(entries: DataFrame, edges: DataFrame, solve, block: int = BLOCK) -> DataFrame:
    """(path, id) of what the entries reach; ``solve`` (entries, edges) does the graph between blocks."""
    base, mark = reached_of(dealt(edges, block, entries=entries.select("path", "id")), solve, block)
    return of_path(packed.in_tasks(base, mark, "path string, id int"))


def reached_of(base: Base, solve, block: int) -> tuple[Base, Look]:
    """(blocks with what they need, the look at a block that gives path and id); ``entries`` are a frame of the blocks."""

    def local(given: dict[str, Arrays]) -> tuple[Nodes, np.ndarray, np.ndarray, Arrays]:
        inside, across = split(given, block)
        if "nodes" in given:
            own = Nodes(given["nodes"])
            return own, *own.edges(inside), across
        sets = [given["entries"], given["into"]] + ([given["told"]] if "told" in given else [])
        ends = [(x["path"], x["id"]) for x in sets] + [(inside["path"], inside["src"]), (inside["path"], inside["dst"]), (across["path"], across["src"])]
        own = Nodes(dict(zip(("path", "id"), joined(*ends), strict=True)))
        return own, *own.edges(inside), across

    def ends(given: dict[str, Arrays]) -> Arrays:
        own, src, dst, across = local(given)
        first = np.unique(own.find(given["entries"]["path"], given["entries"]["id"]))
        seen = packed.reached(len(own), src, dst, first)
        leave, into = own.find(across["path"], across["src"]), np.unique(own.find(given["into"]["path"], given["into"]["id"]))
        out = seen[leave]
        # an entry's way out of the block starts nowhere: it makes its end an entry
        parts = [(across["path"][out], np.full(int(out.sum()), NONE), across["dst"][out])]
        # what the entries reach anyway needs no way from an end
        into = into[~seen[into]]
        for path, a, b in ways(own, src, dst, into, np.unique(leave[~out])):
            parts.append((path, a, b))
        parts.append((across["path"][~out], across["src"][~out], across["dst"][~out]))
        return dict(zip(("path", "src", "dst"), joined(*parts), strict=True)) | {"entry": np.repeat([True] + [False] * (len(parts) - 1), [len(p[0]) for p in parts])}

    found = materialize(of_path(packed.in_tasks(base, ends, "path string, src int, dst int, entry boolean")), "ends")
    told = solve(found.where("entry").select("path", F.col("dst").alias("id")), found.where("not entry").select("path", "src", "dst"))
    told = materialize(told, "solved")

    def mark(given: dict[str, Arrays]) -> Arrays:
        own, src, dst, _ = local(given)
        first = np.unique(np.concatenate([own.find(given[x]["path"], given[x]["id"]) for x in ("entries", "told")]))
        seen = packed.reached(len(own), src, dst, first)
        return {"path": own.path[seen], "id": own.id[seen]}

    return base.plus({"told": by_block(told, "id", block)}), mark


def ways(own: Nodes, src: np.ndarray, dst: np.ndarray, into: np.ndarray, leave: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges (path, src, dst) by which each of ``into`` reaches those of ``leave`` that it reaches inside the pack: straight ones
    where a path has few of ``into``, else all edges on such ways."""
    out = []
    many = np.bincount(own.path[into], minlength=int(own.path.max(initial=0)) + 1) > PAIRS
    few, rest = into[~many[own.path[into]]], into[many[own.path[into]]]
    ending = np.zeros(len(own), bool)
    ending[leave] = True
    alone = len(own) > 0 and own.path[0] == own.path[-1]  # all of the pack is one path's
    start, ahead = packed.neighbours(len(own), src, dst) if len(few) and not alone else ([], [])
    for v in few.tolist():
        if alone:
            ends = np.flatnonzero(packed.reached(len(own), src, dst, np.array([v])) & ending)
            ends = ends[ends != v]
        else:
            seen, left = {v}, [v]
            while left:
                u = left.pop()
                for x in ahead[start[u] : start[u + 1]]:
                    if x not in seen:
                        seen.add(x)
                        left.append(x)
            ends = np.array([u for u in seen if ending[u] and u != v], np.int64)
        out.append((own.path[ends], np.full(len(ends), own.id[v]), own.id[ends]))
    if len(rest):
        on = packed.reached(len(own), src, dst, rest) & packed.reached(len(own), dst, src, leave)
        kept = on[src] & on[dst]
        out.append((own.path[src[kept]], own.id[src[kept]], own.id[dst[kept]]))
    return out


def totals(tree: DataFrame, nodes: DataFrame, kind: str, block: int = BLOCK, most: int = packed.MOST) -> DataFrame | None:
    """(path, wcc, id, ipdom, cf, w, depth, total) of trees (path, wcc, id, ipdom; EXIT at the top) with nodes (path, id, cf, w).

    What comes into a block at a node moves up as x -> max(low, x + plus), and such functions compose. Nodes where something
    comes in or several such ways meet stay, so do the tops; one task does the tree of those. None if it has over ``most`` nodes.
    """
    far = tree.where((F.col("ipdom") != EXIT) & (F.floor(F.col("id") / block) != F.floor(F.col("ipdom") / block)))
    frames = {"tree": by_block(tree, "id", block), "nodes": by_block(nodes, "id", block), "into": by_block(far.select("path", F.col("ipdom").alias("id")), "id", block)}
    found = totals_of(packed.dealt(frames).stored("blocks"), kind, block, most)
    return None if found is None else of_path(packed.in_tasks(*found, f"path string, wcc int, id int, ipdom int, cf boolean, w {kind}, depth int, total {kind}"))


def totals_of(base: Base, kind: str, block: int, most: int = packed.MOST) -> tuple[Base, Look] | None:
    """(blocks with what they need, the look at a block that gives the rows of ``totals``); ``tree``, ``nodes`` and ``into`` are frames
    of the blocks."""

    def kept(given: dict[str, Arrays]) -> Arrays:
        return _Forest(given, block).kept()

    small = packed.in_tasks(base, kept, f"path string, id int, up int, base {kind}, low {kind}, plus {kind}, steps int")
    small = materialize(of_path(small), "kept")
    if packed.oversized(small, most) is not None:
        return None

    def solve(given: dict[str, Arrays]) -> Arrays:
        own = Nodes(given["kept"])
        up, low, plus, base, steps = (own.column(c) for c in ("up", "low", "plus", "base", "steps"))
        up = np.where(up == EXIT, EXIT, np.maximum(own.find(own.path, up), EXIT))
        # an end outside of all blocks is none
        steps = np.where(up == EXIT, 0, steps)
        level = packed.over_ancestors(up)[0]
        order = np.argsort(-level, kind="stable").tolist()
        total, depth = base.tolist(), steps.tolist()
        up, low, plus = up.tolist(), low.tolist(), plus.tolist()
        for i in order:
            total[i] = max(total[i], 0)
            if up[i] >= 0:
                total[up[i]] += max(low[i], total[i] + plus[i])
        for i in reversed(order):
            if up[i] >= 0:
                depth[i] += depth[up[i]]
        return {"path": own.path, "id": own.id, "depth": np.array(depth, np.int64), "total": np.array(total, base.dtype)}

    told = packed.in_tasks({"kept": small}, solve, f"path string, id int, depth int, total {kind}")

    def all_of(given: dict[str, Arrays]) -> Arrays:
        own = _Forest(given, block)
        total, depth = own.told(given["told"])
        columns = {c: own.nodes.column(c) for c in ("wcc", "ipdom")} | {"cf": own.cf, "w": own.w}
        return {"path": own.nodes.path, "id": own.nodes.id} | columns | {"depth": depth, "total": total}

    return base.plus({"told": by_block(materialize(told, "told"), "id", block)}), all_of


class _Forest:
    """What blocks hold of trees: nodes whose parent is in another block are tops here.

    A run is a node that has several children, something that comes in from outside or no parent, or else a chain of neighbouring
    nodes with one child each; the total at a run's end is max(low, x + plus) of the sum x that comes to its start. Sums of
    floating-point numbers depend on their order, so there every node is a run.
    """

    def __init__(self, given: dict[str, Arrays], block: int) -> None:
        known, tree = Nodes(given["nodes"]), given["tree"]
        at = known.find(tree["path"], tree["id"])
        if (at < 0).any():
            tree, at = {c: x[at >= 0] for c, x in tree.items()}, at[at >= 0]
        self.nodes = Nodes(tree)
        at = at[self.nodes.first]
        self.cf, self.w, self.above = known.column("cf")[at], known.column("w")[at], self.nodes.column("ipdom")
        self.outside = (self.above != EXIT) & (self.above // block != self.nodes.id // block)
        self.up = up = np.where(self.outside | (self.above == EXIT), EXIT, np.maximum(self.nodes.find(self.nodes.path, self.above), EXIT))
        n, into = len(up), self.nodes.find(given["into"]["path"], given["into"]["id"])
        self.into = np.unique(into[into >= 0])
        own = (up < 0) | (np.bincount(up[up >= 0], minlength=n) > 1)
        own[self.into] = True
        linked = np.zeros(n, bool)
        if self.w.dtype.kind == "i":
            linked[1:] = (up[:-1] == np.arange(1, n)) & ~own[1:] & ~own[:-1]
        self.start = np.flatnonzero(~linked)
        self.run = np.cumsum(~linked) - 1
        self.end = np.append(self.start[1:], n)[: len(self.start)] - 1
        # sums from the start of the run, and the least one so far
        self.sums = np.cumsum(self.w) if len(self.start) < n else self.w.copy()
        if len(self.start) < n:
            self.sums -= (self.sums[self.start] - self.w[self.start])[self.run]
        self.least = self._least()
        self.low = (self.sums - self.least)[self.end] if len(self.start) < n else np.zeros(n, self.w.dtype)
        self.plus, self.size = self.sums[self.end], self.end - self.start + 1
        self.over = np.where(up[self.end] >= 0, self.run[np.maximum(up[self.end], 0)], EXIT)
        level, self.top, _ = packed.over_ancestors(self.over)
        self.order = np.argsort(-level, kind="stable").tolist()

    def _least(self) -> np.ndarray:
        if len(self.start) == len(self.sums):
            return self.sums
        # later runs are moved below all earlier ones, so that one pass does them all
        wide = int(self.sums.max()) - int(self.sums.min()) + 1
        if wide * len(self.start) < 1 << 62:
            moved = self.run * wide
            return np.minimum.accumulate(self.sums - moved) + moved
        return np.concatenate([np.minimum.accumulate(x) for x in np.split(self.sums, self.start[1:])])

    def kept(self) -> Arrays:
        """The nodes that stay, with what is known of their sums, and how their totals get to the next one up."""
        runs, up, low_of, plus_of, size = len(self.start), self.over.tolist(), self.low.tolist(), self.plus.tolist(), self.size.tolist()
        # open: something from outside comes in at the run or below it
        open_ = [False] * runs
        for r in self.run[self.into].tolist():
            while r >= 0 and not open_[r]:
                open_[r] = True
                r = up[r]
        total = plus_of[:]
        for r in self.order:
            if not open_[r] and up[r] >= 0:
                most = max(low_of[r], total[r])
                if most > 0:
                    total[up[r]] += most
        opened = np.array(open_, bool)
        ways = np.bincount(self.over[opened & (self.over >= 0)], minlength=runs)
        stays = (opened & ((ways > 1) | (self.over < 0))) | self.outside[self.end]
        stays[self.run[self.into]] = True
        ends, last = np.flatnonzero(stays), stays.tolist()
        zero = self.w.dtype.type(0).item()
        rows = []
        for r in ends.tolist():
            low, plus, steps, at = zero, zero, 1, up[r]
            while at >= 0 and not last[at]:
                low, plus, steps, at = max(low_of[at], total[at] + low), plus + total[at], steps + size[at], up[at]
            rows.append((at, low, plus, steps))
        at, low, plus, steps = (np.array(c) for c in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 4
        # runs that stay are single nodes
        node = self.end[ends]
        above = np.where(at >= 0, self.nodes.id[self.start[np.maximum(at, 0)]], np.where(self.outside[node], self.above[node], EXIT)) if rows else at
        known = np.array(total, self.w.dtype)[ends]
        return {"path": self.nodes.path[node], "id": self.nodes.id[node], "up": above, "base": known, "low": low.astype(self.w.dtype), "plus": plus.astype(self.w.dtype), "steps": steps}

    def told(self, given: Arrays) -> tuple[np.ndarray, np.ndarray]:
        """(total, depth) of all nodes, given those of the ones that stay."""
        runs, up, low_of, plus_of = len(self.start), self.over.tolist(), self.low.tolist(), self.plus.tolist()
        at = self.run[self.nodes.find(given["path"], given["id"])]
        # what comes to a run, and the totals of those that are told
        comes, fixed, first = [self.w.dtype.type(0).item()] * runs, [None] * runs, [0] * runs
        for r, x, d in zip(at.tolist(), given["total"].tolist(), given["depth"].tolist(), strict=True):
            fixed[r], first[r] = x, d
        total = [0] * runs
        if self.w.dtype.kind != "i":
            # a node's sum starts with its own weight, in the order of its children
            comes = plus_of[:]
        for r in self.order:
            if fixed[r] is not None:
                total[r] = fixed[r]
            elif self.w.dtype.kind == "i":
                total[r] = max(low_of[r], comes[r] + plus_of[r])
            else:
                total[r] = max(comes[r], 0)
            if up[r] >= 0:
                comes[up[r]] += total[r]
        depth, size = first[:], self.size.tolist()
        for r in reversed(self.order):
            if up[r] >= 0:
                depth[r] = depth[up[r]] + size[up[r]]
        depth = np.array(depth, np.int64)[self.run] + self.end[self.run] - np.arange(len(self.up))
        total = np.array(total, self.w.dtype)
        if runs < len(self.up):
            inside = np.maximum(self.sums - self.least, self.sums + np.array(comes, self.w.dtype)[self.run])
            inside[self.end] = total
            total = inside
        return total, depth


class _Strong:
    """Strong components of blocks: inside a block, or with what is told of the ends of edges between blocks (id, group)."""

    def __init__(self, given: dict[str, Arrays], block: int) -> None:
        self.nodes = own = Nodes(given["nodes"])
        inside, self.across = split(given, block)
        self.src, self.dst = own.edges(inside)
        src, dst, at, group = self.src, self.dst, np.empty(0, np.int64), np.empty(0, np.int64)
        if "told" in given:
            told = given["told"]
            at, group = own.find(told["path"], told["id"]), told["group"].astype(np.int64)
            order = np.lexsort((group, own.path[at]))
            at, group = at[order], group[order]
            # the ends of a group in a block are put in a ring
            new = np.append(True, (group[1:] != group[:-1]) | (own.path[at][1:] != own.path[at][:-1])) if len(at) else np.empty(0, bool)
            first = np.flatnonzero(new)
            follow = np.arange(1, len(at) + 1)
            follow[np.append(first[1:], len(at))[: len(first)] - 1] = first
            src, dst = np.concatenate([src, at]), np.concatenate([dst, at[follow] if len(at) else at])
        self.name = packed.strong(len(own), src, dst)
        # the group of each component that goes beyond its block
        self.group = np.full(len(own), NONE)
        self.group[self.name[at]] = group
        self.group = self.group[self.name]


def strong_ends(base: Base, solve, block: int) -> tuple[DataFrame, DataFrame]:
    """((path, id, group) of ends of edges between blocks in a component that goes beyond its block, named by one of its ends;
    (path, id, dst, same): the edges between blocks with two known ends, and whether these are in one component).

    Where edges lead to later blocks only no component goes beyond its block."""
    if isinstance(base, Laid) and base.one_way:
        links = base.across.select("path", F.col("src").alias("id"), "dst", F.lit(False).alias("same"))
        return links.limit(0).select("path", "id", F.col("dst").alias("group")), links

    def ends(given: dict[str, Arrays]) -> Arrays:
        own = _Strong(given, block)
        nodes, across = own.nodes, own.across
        leave, into = nodes.find(across["path"], across["src"]), np.unique(nodes.find(given["into"]["path"], given["into"]["id"]))
        known, into = leave >= 0, into[into >= 0]
        at = np.unique(np.concatenate([leave[known], into]))
        parts = [(nodes.path[at], nodes.id[at], nodes.id[at]), (across["path"][known], across["src"][known], across["dst"][known])]
        parts += ways(nodes, own.src, own.dst, into, np.unique(leave[known]))
        sizes = [len(p[0]) for p in parts]
        return dict(zip(("path", "src", "dst"), joined(*parts), strict=True)) | {"kind": np.repeat(np.minimum(np.arange(len(parts)), 2), sizes)}

    found = materialize(of_path(packed.in_tasks(base, ends, "path string, src int, dst int, kind int")), "ends")
    some = found.where("kind <> 1").select("path", F.explode(F.array("src", "dst")).alias("id")).distinct()
    solved = materialize(solve(found.where("kind > 0").select("path", "src", "dst"), some), "solved")
    beyond = solved.groupBy("path", "scc").agg(F.count("*").alias("n")).where("n > 1").select("path", "scc")
    told = materialize(solved.join(beyond, ["path", "scc"]).select("path", "id", F.col("scc").alias("group")), "told")
    of = lambda c: solved.select("path", F.col("id").alias(c), F.col("scc").alias(f"{c}_scc"))
    links = found.where("kind = 1").select("path", "src", "dst").join(of("src"), ["path", "src"]).join(of("dst"), ["path", "dst"])
    return told, materialize(links.select("path", F.col("src").alias("id"), "dst", (F.col("src_scc") == F.col("dst_scc")).alias("same")), "links")


def strong(nodes: DataFrame, edges: DataFrame, solve, block: int = BLOCK) -> DataFrame:
    """(path, id, scc) of strong components, named by their smallest node; ``solve`` (edges, nodes) does the graph between blocks."""
    base = dealt(edges, block, nodes=nodes.select("path", "id"))
    told, _ = strong_ends(base, solve, block)
    base = base.plus({"told": by_block(told, "id", block)})

    def all_of(given: dict[str, Arrays]) -> Arrays:
        own = _Strong(given, block)
        return {"path": own.nodes.path, "id": own.nodes.id, "scc": own.nodes.id[own.name], "group": own.group}

    found = materialize(of_path(packed.in_tasks(base, all_of, "path string, id int, scc int, group int")), "strong")
    least = found.where(F.col("group") != NONE).groupBy("path", "group").agg(F.min("scc").alias("least"))
    beyond = found.where(F.col("group") != NONE).join(least, ["path", "group"]).select("path", "id", F.col("least").alias("scc"))
    return found.where(F.col("group") == NONE).select("path", "id", "scc").unionByName(beyond)


def exits(base: Base, told: DataFrame, links: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """((path, id) of the nodes that the virtual exit follows, whether some component is left by no way at all).

    ``base`` has cf of its nodes.
    """
    base = base.plus({"told": by_block(told, "id", block), "links": by_block(links, "id", block)})

    def looked(given: dict[str, Arrays]) -> tuple[_Strong, np.ndarray, np.ndarray, np.ndarray]:
        own = _Strong(given, block)
        n, name = len(own.nodes), own.name
        leaving = np.zeros(n, bool)
        leaving[name[own.src][name[own.src] != name[own.dst]]] = True
        far = given["links"]
        at = own.nodes.find(far["path"], far["id"])
        leaving[name[at[(at >= 0) & ~far["same"].astype(bool)]]] = True
        cf = own.nodes.column("cf").astype(bool)
        some = np.bincount(name[cf], minlength=n) > 0
        return own, leaving[name], np.bincount(name, minlength=n)[name], some[name]

    def parts(given: dict[str, Arrays]) -> Arrays:
        own, leaving, size, some = looked(given)
        at = np.flatnonzero((own.name == np.arange(len(own.name))) & (own.group != NONE))
        return {"path": own.nodes.path[at], "group": own.group[at], "leaving": leaving[at], "some": some[at], "id": own.nodes.id[at]}

    if told.isEmpty():
        groups = told.select("path", "group", F.lit(False).alias("leaving"), F.lit(False).alias("some"))
    else:
        groups = of_path(packed.in_tasks(base, parts, "path string, group int, leaving boolean, some boolean, id int"))
    groups = materialize(groups.groupBy("path", "group").agg(F.max("leaving").alias("leaving"), F.max("some").alias("some")), "groups")
    ended = told.join(groups, ["path", "group"]).select("path", "id", "leaving", "some")

    def last(given: dict[str, Arrays]) -> Arrays:
        own, leaving, size, some = looked(given)
        told = given["groups"]
        at = own.name[own.nodes.find(told["path"], told["id"])]
        for flags, c in ((leaving, "leaving"), (some, "some")):
            whole = np.zeros(len(flags), bool)
            whole[at] = told[c].astype(bool)
            flags |= whole[own.name]
        single = (size == 1) & (own.group == NONE)
        out = ~leaving & (single | own.nodes.column("cf").astype(bool))
        dead = np.flatnonzero(~leaving & ~single & ~some & (own.name == np.arange(len(out))))
        at = np.concatenate([np.flatnonzero(out), dead])
        return {"path": own.nodes.path[at], "id": own.nodes.id[at], "dead": np.repeat([False, True], [int(out.sum()), len(dead)])}

    found = packed.in_tasks(base.plus({"groups": by_block(ended, "id", block)}), last, "path string, id int, dead boolean")
    found = materialize(of_path(found), "exits")
    return found.where("not dead").select("path", "id"), not found.where("dead").isEmpty()


class _Local:
    """Post-dominators inside blocks: a node's one in its block is its one at all; a ``top`` has none in its block.

    The last node stands for the exit.
    """

    def __init__(self, given: dict[str, Arrays], block: int) -> None:
        self.nodes = own = Nodes(given["nodes"])
        n, self.links = len(own), given["links"]
        src, dst = own.edges(split(given, block)[0])
        last = own.find(given["last"]["path"], given["last"]["id"])
        self.leave = own.find(self.links["path"], self.links["id"])
        self.src, self.dst = np.concatenate([src, last]), np.concatenate([dst, np.full(len(last), n)])
        out = np.zeros(n + 1, bool)
        out[self.leave] = out[n] = True
        self.up = packed.post_dominator_tree(n + 1, self.src, self.dst, out)
        self.top = self.up == EXIT
        self.top[n] = False

    def ids(self, at: np.ndarray) -> np.ndarray:
        return np.append(self.nodes.id, EXIT)[at]

    def kept(self, into: np.ndarray) -> Arrays:
        """The graph of what others need: nodes that edges come to from other blocks, tops, what follows tops, and where ways
        from those meet in the block's trees."""
        n, up = len(self.nodes), self.up.tolist()
        of_top = self.top[self.src] & (self.dst < n)
        wanted = np.unique(np.concatenate([into[into >= 0], np.flatnonzero(self.top), self.dst[of_top]]))
        wanted = wanted[self.up[wanted] != NONE]
        # all ways up, each until it comes to an earlier one: places on them in order, where each begins and what it comes to
        place, count, begins, comes = [NONE] * n + [0], 0, [], []
        for v in wanted.tolist():
            begins.append(count)
            while v >= 0 and place[v] < 0:
                place[v] = count
                count += 1
                v = up[v]
            comes.append(v)
        begins, comes = np.array(begins, np.int64), np.array(comes, np.int64)
        kept = np.union1d(wanted, comes[(comes >= 0) & (comes < n)])
        at = np.array([place[v] for v in kept.tolist()], np.int64)
        kept, at = kept[order := np.argsort(at)], at[order]
        way = np.searchsorted(begins, at, "right") - 1
        # the next one on the same way, or what the way comes to
        follows = np.append(way[1:] == way[:-1], False) if len(kept) else np.empty(0, bool)
        parents = np.where(follows, np.append(kept[1:], EXIT)[: len(kept)], comes[way])
        below = ~self.top[kept]
        under, parents = kept[below], parents[below]
        edge = self.top[self.src]
        far = self.top[self.leave]
        own = self.nodes
        return dict(
            zip(
                ("path", "src", "dst"),
                joined(
                    (own.path[under], own.id[under], self.ids(parents)),
                    (own.path[self.src[edge]], own.id[self.src[edge]], self.ids(self.dst[edge])),
                    (own.path[self.leave[far]], own.id[self.leave[far]], self.links["dst"][far]),
                ),
                strict=True,
            )
        )


def post_dominators(nodes: DataFrame, edges: DataFrame, solve_weak, solve_strong, solve_tree, block: int = BLOCK) -> DataFrame | None:
    """(path, wcc, id, ipdom; EXIT for the exit) of nodes (path, id, cf). ``solve_tree`` (edges with EXIT among the ends) does the
    tree of the graph between blocks. None if some node does not reach the exit.

    A node's post-dominators inside its block, with every edge out of the block as an end, are on all of its ways; the others are
    those of its top there. So tops and what lies between them make a graph of their own with the same answers.
    """
    base = dealt(edges, block, nodes=nodes.select("path", "id", "cf"))
    found = post_dominators_of(base, solve_weak, solve_strong, solve_tree, block)
    return None if found is None else of_path(packed.in_tasks(*found, "path string, wcc int, id int, ipdom int"))


def post_dominators_of(base: Base, solve_weak, solve_strong, solve_tree, block: int) -> tuple[Base, Look] | None:
    """(blocks with what they need, the look at a block that gives path, id, ipdom, and wcc unless ``solve_weak`` is None); ``nodes``
    and ``edges`` are frames of the blocks."""
    told, links = strong_ends(base, solve_strong, block)
    last, dead = exits(base, told, links, block)
    if dead:
        return None
    named = solve_weak is not None
    parts = {"parts": by_block(weak_ends(base, solve_weak, block), "id", block)} if named else {}
    base = base.plus({"last": by_block(last, "id", block), "links": by_block(links.select("path", "id", "dst"), "id", block)})

    def between(given: dict[str, Arrays]) -> Arrays:
        own = _Local(given, block)
        return own.kept(np.unique(own.nodes.find(given["into"]["path"], given["into"]["id"])))

    small = materialize(of_path(packed.in_tasks(base, between, "path string, src int, dst int")), "between")
    tree = materialize(solve_tree(small), "tree")

    def all_of(given: dict[str, Arrays]) -> Arrays:
        own, tree = _Local(given, block), given["tree"]
        n, above = len(own.nodes), own.ids(own.up)
        at = own.nodes.find(tree["path"], tree["id"])
        above[at[own.top[at]]] = tree["ipdom"][own.top[at]]
        out = {"path": own.nodes.path, "id": own.nodes.id, "ipdom": above[:n]}
        return out | {"wcc": _named(own.nodes, given, block)} if named else out

    return base.plus({"tree": by_block(tree, "id", block)} | parts), all_of
