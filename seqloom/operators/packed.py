"""Many graphs in one task: tables that share a key are packed into arrays, up to a size that a task can hold.

``in_tasks`` deals rows by their ``path``, runs through the graphs of a task in order and hands some at a time to a function
of numpy arrays. The algorithms below work on node numbers of such a pack, in which graphs do not touch each other.
Memory is in proportion to the largest graph, or to ``PACK`` rows of small ones.

Rows without a path are left out, and so are edges with an end that is not among the nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import digests
from seqloom.plans.lineage import materialize

PACK = 100_000  # rows that are handed over together, if graphs are smaller
GATHER = 4096  # rows of a path that are shipped as one
MOST = 1_000_000  # nodes of a graph that one task takes
EXIT, NONE = -1, -2

Arrays = dict[str, np.ndarray]


def oversized(nodes: DataFrame, most: int, keys: tuple[str, ...] = ("path",)) -> DataFrame | None:
    """The keys with more than ``most`` nodes, None if there is no such key."""
    big = nodes.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys)
    return None if big.isEmpty() else big


def _writer(schema: str) -> Callable[[Arrays, pa.Array], Iterator[pa.RecordBatch]]:
    """Batches of ``schema`` from columns whose path is a number of one of the paths."""
    types = T._parse_datatype_string(schema)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [kinds[f.dataType.simpleString()] for f in types.fields]

    def write(out: Arrays, paths: pa.Array) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(out["path"]), PACK):
            part = slice(k, k + PACK)
            arrays = [paths.take(pa.array(out["path"][part], pa.int64()))] + [pa.array(out[f.name][part], k) for f, k in zip(types.fields[1:], kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=types.fieldNames())

    return write


class Contents:
    """Graphs that follow from one row each: (path, content), content in bytes, no path twice.

    ``decode`` makes the frames of some rows from arrays: the number of the path, the place and the value of every byte, and
    the length of its content. Such graphs are made where the row is, and nothing of them is dealt.
    """

    def __init__(self, rows: DataFrame, decode: Callable[..., dict[str, Arrays]]) -> None:
        self.rows, self.decode = rows.select("path", "content"), decode

    def in_tasks(self, fn: Callable[[dict[str, Arrays]], Arrays], schema: str, pack: int = PACK) -> DataFrame:
        """``fn`` of the frames of some rows at a time, as ``in_tasks``."""
        decode, out_rows = self.decode, _writer(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for paths, bytes_of in _packs(batches, pack):
                yield from out_rows(fn(decode(**bytes_of)), paths)

        return self._filled().mapInArrow(run, schema)

    def digested(self, columns: list[str], pack: int = PACK) -> DataFrame:
        """(path, rows, digest): how many rows the frames have, and the sum of the codes of their texts.

        A row's text is its ``columns`` with bars between; one is a field or a list of them, as ``digests.codes`` takes them.
        """
        decode, out_rows = self.decode, _writer("path string, rows bigint, digest bigint")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for paths, bytes_of in _packs(batches, pack):
                names = digests.Texts([x.encode() for x in paths.to_pylist()])
                count, total = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
                for frame in decode(**bytes_of).values():
                    own, fields = frame["path"], []
                    for c in columns:
                        field = (names, own) if c == "path" else frame[c]
                        fields += [b"|", *(field if isinstance(field, list) else [field])]
                    count += np.bincount(own, minlength=len(paths))
                    np.add.at(total, own, digests.codes(fields[1:], len(own)))
                there = np.flatnonzero(count)
                yield from out_rows({"path": there, "rows": count[there], "digest": total[there]}, paths)

        return self._filled().mapInArrow(run, "path string, rows bigint, digest bigint")

    def _filled(self) -> DataFrame:
        return self.rows.where("path is not null and octet_length(content) > 0")


def _packs(batches: Iterator[pa.RecordBatch], pack: int) -> Iterator[tuple[pa.Array, Arrays]]:
    """(paths, arrays of their bytes as ``Contents`` has them) of some rows (path, content) at a time."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(size), 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + pack, "right")))
            n, body = size[first:last], b"".join(batch.column(1).slice(first, last - first).to_pylist())
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            path = np.repeat(np.arange(len(n)), n)
            yield batch.column(0).slice(first, last - first), {"path": path, "off": at, "byte": np.frombuffer(body, np.uint8), "n": np.repeat(n, n)}
            first = last


class Dealt:
    """Frames whose rows of a path are gathered into rows of lists; ``plus`` adds more frames, ``stored`` cuts the lineage."""

    def __init__(self, rows: DataFrame, columns: dict[str, list[str]]) -> None:
        self.rows, self.columns = rows, columns

    def plus(self, frames: dict[str, DataFrame]) -> Dealt:
        more = dealt(frames)
        return Dealt(self.rows.unionByName(more.rows, allowMissingColumns=True), self.columns | more.columns)

    def stored(self, name: str) -> Dealt:
        return Dealt(materialize(self.rows, name), self.columns)


def _together(done: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if done:
        yield from pa.Table.from_batches(done).combine_chunks().to_batches()


class Laid:
    """Blocks of ``block`` neighbouring ids whose frames follow from a row each: (path, ...), no path twice.

    ``decode`` makes the frames of a row, given as a batch of one; the number of its path is 0. What is known of the edges between
    blocks goes with it: ``one_way`` tells whether they all lead to later blocks. ``plus`` adds rows of tables to the blocks' rows.
    """

    def __init__(self, rows: DataFrame, decode: Callable[[pa.RecordBatch], dict[str, Arrays]], block: int, names: tuple[str, ...] = (), across: DataFrame | None = None, one_way: bool = False) -> None:
        self.rows, self.decode, self.block, self.names, self.across, self.one_way = rows, decode, block, names, across, one_way

    def plus(self, frames: dict[str, DataFrame]) -> Laid:
        rows = self.rows
        for name, df in frames.items():
            lists = df.where("path is not null").groupBy("path").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "path"))).alias(f"_{name}"))
            rows = rows.join(lists, "path", "left")
        return Laid(rows, self.decode, self.block, (*self.names, *frames), self.across, self.one_way)

    def in_tasks(self, fn: Callable[[dict[str, Arrays]], Arrays], schema: str) -> DataFrame:
        """``fn`` of the frames of a block at a time, as ``in_tasks``."""
        decode, names, out_rows = self.decode, self.names, _writer(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done, count = [], 0
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    given = decode(row)
                    for name in names:
                        held = row.column(f"_{name}").flatten()
                        columns = {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(held.type, held.flatten(), strict=True)}
                        given[name] = {"path": np.zeros(len(held), np.int64)} | columns
                    # few rows come of a block, so those of many are handed over together
                    done += out_rows(fn(given), row.column("path"))
                    count += done[-1].num_rows if done else 0
                    if count >= PACK:
                        yield from _together(done)
                        done, count = [], 0
                yield from _together(done)

        return self.rows.mapInArrow(run, schema)


def dealt(frames: dict[str, DataFrame]) -> Dealt:
    """The frames as lists. They have path and columns without nulls; rows without a path are left out.

    Rows of a path that lie near each other are gathered into one row of lists before they are dealt, so that shuffles and
    sorts see few and small ones.
    """
    columns = {name: [c for c in df.columns if c != "path"] for name, df in frames.items()}
    rows = None
    for name, df in frames.items():
        given = gathered(df.where("path is not null").select("path", *columns[name]), [f"{name}_{k}" for k in range(len(columns[name]))])
        rows = given if rows is None else rows.unionByName(given, allowMissingColumns=True)
    return Dealt(rows, columns)


def in_tasks(frames: dict[str, DataFrame] | Dealt | Laid, fn: Callable[[dict[str, Arrays]], Arrays], schema: str, pack: int = PACK) -> DataFrame:
    """``fn`` of the frames' rows of some paths at a time; it gets numbers for the paths and returns columns of ``schema``,
    which starts with path."""
    if isinstance(frames, Laid):
        return frames.in_tasks(fn, schema)
    whole_frames = frames if isinstance(frames, Dealt) else dealt(frames)
    rows, columns = whole_frames.rows, whole_frames.columns
    lists = {name: [f"{name}_{k}" for k in range(len(own))] for name, own in columns.items()}
    out_rows = _writer(schema)

    def handle(table: pa.Table, codes: np.ndarray, paths: pa.Array) -> Iterator[pa.RecordBatch]:
        given = {}
        for name, own in columns.items():
            held = [table.column(at).combine_chunks() for at in lists[name]]
            given[name] = {"path": np.repeat(codes, held[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))}
            given[name] |= {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in zip(own, held, strict=True)}
        yield from out_rows(fn(given), paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for batch in batches:
            path = batch.column(0).to_pylist()
            size = sum(batch.column(f"{name}_0").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for name in columns)
            first = 0
            for k, own in enumerate(path):
                # a pack ends where a path does
                if own != last and count >= pack:
                    held.append(batch.slice(first, k - first))
                    yield from whole(held)
                    held, count, first = [], 0, k
                count, last = count + int(size[k]), own
            held.append(batch.slice(first))
        if held:
            yield from whole(held)

    def whole(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            codes = table.column(0).combine_chunks().dictionary_encode()
            yield from handle(table, codes.indices.to_numpy().astype(np.int64), codes.dictionary)

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)


def gathered(df: DataFrame, names: list[str], most: int = GATHER) -> DataFrame:
    """Rows (path, columns) as rows of lists called ``names``, each of at most ``most`` rows of a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= 16 * most:
                yield lists(held)
                held, count = [], 0
        if count:
            yield lists(held)

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        codes = table.column(0).combine_chunks().dictionary_encode()
        own = codes.indices.to_numpy()
        if (own[1:] < own[:-1]).any():
            order = np.argsort(own, kind="stable")
            table, own = table.take(pa.array(order)), own[order]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        # long ones are cut
        size = np.diff(np.append(new, len(own)))
        parts = -(-size // most)
        first = np.repeat(new, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * most
        ends = pa.array(np.append(first, len(own)).astype(np.int32))
        paths = codes.dictionary.take(pa.array(own[first]))
        return pa.RecordBatch.from_arrays([paths, *(pa.ListArray.from_arrays(ends, c.combine_chunks()) for c in table.columns[1:])], names=["path", *names])

    kinds = [k for c, k in df.dtypes if c != "path"]
    return df.mapInArrow(run, ", ".join(["path string", *(f"{n} array<{k}>" for n, k in zip(names, kinds, strict=True))]))


def once(df: DataFrame, by: str, block: int = PACK) -> DataFrame:
    """Each row of integers (path, columns) once, a block of values of ``by`` at a time; a missing path is one of its own."""
    names = [c for c in df.columns if c != "path"]

    def find(given: dict[str, Arrays]) -> Arrays:
        own = given["rows"]
        columns = [own["path"], *(own[c] for c in names)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) if len(order) else np.empty(0, bool)
        return dict(zip(("path", *names), (c[new] for c in columns), strict=True))

    key = F.concat_ws("/", F.floor(F.col(by) / block), "path")
    out = in_tasks({"rows": df.select(key.alias("path"), *names)}, find, ", ".join(["path string", *(f"{c} {k}" for c, k in df.select(*names).dtypes)]))
    return out.withColumn("path", F.expr("if(instr(path, '/') > 0, substr(path, instr(path, '/') + 1), null)"))


def keys_of(path: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (path << 32) + (ids.astype(np.int64) + (1 << 31))


class Nodes:
    """The distinct nodes of a pack by path and id; a node's number is its place in that order.

    Ids that come in order are not sorted again, and ones without a gap are found without a search.
    """

    def __init__(self, given: Arrays) -> None:
        keys = keys_of(given["path"], given["id"])
        if (keys[1:] > keys[:-1]).all():
            first = np.arange(len(keys))
        else:
            keys, first = np.unique(keys, return_index=True)
        self.keys, self.given, self.first = keys, given, first
        self.path, self.id = given["path"][first], given["id"][first].astype(np.int64)
        self.dense = len(keys) > 0 and int(keys[-1] - keys[0]) == len(keys) - 1

    def __len__(self) -> int:
        return len(self.keys)

    def column(self, name: str) -> np.ndarray:
        return self.given[name][self.first]

    def find(self, path: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers, NONE for ids that are no nodes."""
        if not len(self.keys):
            return np.full(len(path), NONE)
        keys = keys_of(path, ids)
        if self.dense:
            at = keys - self.keys[0]
            return np.where((at >= 0) & (at < len(self.keys)), at, NONE)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, NONE)

    def edges(self, given: Arrays) -> tuple[np.ndarray, np.ndarray]:
        src, dst = self.find(given["path"], given["src"]), self.find(given["path"], given["dst"])
        known = (src >= 0) & (dst >= 0)
        return src[known], dst[known]


def neighbours(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """(where each node's part begins, ends of all edges by their start)."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()


def weak(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of each one's component. Neighbours with an edge between them are runs, and edges join those."""
    near = np.abs(dst - src) == 1
    linked = np.zeros(n, bool)
    linked[np.maximum(src, dst)[near]] = True
    first = np.flatnonzero(~linked)
    if len(first) == n:
        return _weak(n, src, dst)
    run, far = np.cumsum(~linked) - 1, ~near
    return first[_weak(len(first), run[src[far]], run[dst[far]])][run]


def _weak(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The same without runs: roots hook on to smaller ones, and pointers jump."""
    label = np.arange(n)
    while True:
        a, b = label[src], label[dst]
        low, new = np.minimum(a, b), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of each one's strong component, by one depth-first pass with low links.

    A cycle goes back over all places that it goes forward over, so only nodes that an edge back spans are looked at.
    """
    back = dst < src
    spans = np.bincount(dst[back], minlength=n + 1) - np.bincount(src[back] + 1, minlength=n + 1)[: n + 1]
    within = np.flatnonzero(np.cumsum(spans)[:n] > 0)
    if len(within) < n:
        out, place = np.arange(n), np.full(n, NONE)
        place[within] = np.arange(len(within))
        if len(within):
            kept = (place[src] >= 0) & (place[dst] >= 0)
            out[within] = within[_strong(len(within), place[src[kept]], place[dst[kept]])]
        return out
    return _strong(n, src, dst)


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    start, ahead = neighbours(n, src, dst)
    at, seen, low, name = start[:], [0] * n, [0] * n, [-1] * n
    count, open_ = 0, []
    for root in range(n):
        calls = [] if seen[root] else [root]
        while calls:
            v = calls[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                open_.append(v)
            if at[v] < start[v + 1]:
                u = ahead[at[v]]
                at[v] += 1
                if not seen[u]:
                    calls.append(u)
                elif name[u] < 0 and seen[u] < low[v]:
                    low[v] = seen[u]
                continue
            calls.pop()
            if calls and low[v] < low[calls[-1]]:
                low[calls[-1]] = low[v]
            if low[v] == seen[v]:
                k = len(open_) - 1
                while open_[k] != v:
                    k -= 1
                least = min(open_[k:])
                for u in open_[k:]:
                    name[u] = least
                del open_[k:]
    return np.array(name, np.int64)


def exits(src: np.ndarray, dst: np.ndarray, name: np.ndarray, cf: np.ndarray) -> np.ndarray:
    """Which nodes the virtual exit follows, given the strong components."""
    n = len(name)
    leaving = np.zeros(n, bool)
    leaving[name[src][name[src] != name[dst]]] = True
    return ~leaving[name] & ((np.bincount(name, minlength=n)[name] == 1) | cf)


def post_dominator_tree(n: int, src: np.ndarray, dst: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The immediate post-dominator of every node: EXIT, a node, or NONE where no way leads to the exit."""
    out = forward_tree(n, src, dst, last) if len(src) and (dst > src).all() else None
    return _post_dominator_tree(n, src, dst, last) if out is None else out


def forward_tree(n: int, src: np.ndarray, dst: np.ndarray, last: np.ndarray, turns: int = 200) -> np.ndarray | None:
    """The same of a graph whose edges all go to later nodes and where every way leads to the exit; None for others, or if it is
    not done after so many turns.

    ``up`` starts as the furthest end of a node's edges, which its post-dominator cannot come before. All edges at once climb from
    their ends along ``up``; one that passes its start's ``up`` lifts it, never above the post-dominator, since what an edge climbs
    to can be reached from its start. When a climb from all ends meets at ``up`` everywhere, later nodes are right, and so are those
    before them.
    """
    up = np.full(n + 1, NONE)
    np.maximum.at(up, src, dst)
    up[:n][last] = up[n] = n
    if (up == NONE).any():
        return None
    # the other edges lead to where their start has its post-dominator, or the exit is it
    active = dst != up[src]
    several = np.zeros(n + 1, bool)
    several[src[active]] = True
    active = several[src] & (up[src] != n)
    src, dst = src[active], dst[active]
    while turns > 0:
        at, before, live = dst.copy(), up.copy(), np.arange(len(src))
        while len(live) and turns > 0:
            turns -= 1
            own, here = src[live], at[live]
            lower = here < up[own]
            at[live[lower]] = up[here[lower]]
            np.maximum.at(up, own, at[live])
            live = np.flatnonzero(at != up[src])
        if not len(live) and np.array_equal(before, up):
            return np.where(up[:n] == n, EXIT, up[:n])
    return None


def _post_dominator_tree(n: int, src: np.ndarray, dst: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The same of any graph: semi-dominators of the reversed graph with compressed paths, then the first ancestor at or above them."""
    begin, back = neighbours(n, dst, src)
    number, order, above, to_exit = [NONE] * n, [EXIT], [0], last.tolist()
    for root in np.flatnonzero(last).tolist():
        stack = [(root, 0)]
        while stack:
            v, up = stack.pop()
            if number[v] == NONE:
                number[v] = len(order)
                order.append(v)
                above.append(up)
                stack += [(u, number[v]) for u in back[begin[v] : begin[v + 1]] if number[u] == NONE]
    start, ahead = neighbours(n, src, dst)
    link, best, semi = above[:], list(range(len(order))), list(range(len(order)))
    for i in range(len(order) - 1, 0, -1):
        v = order[i]
        low = 0 if to_exit[v] else above[i]
        for u in ahead[start[v] : start[v + 1]]:
            j = number[u]
            if j > i:
                trail = []
                while link[j] > i:
                    trail.append(j)
                    j = link[j]
                m = best[j]
                for y in reversed(trail):
                    if semi[best[y]] > semi[m]:
                        best[y] = m
                    else:
                        m = best[y]
                    link[y] = link[j]
                j = semi[m]
            elif j == NONE:
                continue
            if j < low:
                low = j
        semi[i] = low
    up = above
    for i in range(1, len(order)):
        d = up[i]
        while d > semi[i]:
            d = up[d]
        up[i] = d
    out = np.full(n, NONE)
    out[np.array(order[1:], np.int64)] = np.array(order)[np.array(up[1:], np.int64)] if len(order) > 1 else 0
    return out


def over_ancestors(up: np.ndarray, *flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(depth, top ancestor, whether all proper ancestors have each flag); pointers double until all are at the top."""
    at, depth, top = up.copy(), (up >= 0).astype(np.int64), np.where(up >= 0, up, np.arange(len(up)))
    every = [np.where(up >= 0, f[np.maximum(up, 0)], True) for f in flags]
    while (live := np.flatnonzero(at >= 0)).size:
        far = at[live]
        depth[live] += depth[far]
        top[live] = top[far]
        for f in every:
            f[live] &= f[far]
        at[live] = at[far]
    return depth, top, every


def totals(up: np.ndarray, depth: np.ndarray, w: np.ndarray) -> np.ndarray:
    """max(0, w + positive totals of the children) of every node, deepest first."""
    total, parent = w.tolist(), up.tolist()
    for i in np.argsort(-depth, kind="stable").tolist():
        if total[i] < 0:
            total[i] = 0
        if parent[i] >= 0:
            total[parent[i]] += total[i]
    return np.array(total, w.dtype)


def reached(n: int, src: np.ndarray, dst: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the nodes ``first`` reach. A node with an edge to the next one is in its run, of which all is reached from some
    place on; only the other edges are followed one by one."""
    near = dst - src == 1
    linked = np.zeros(n, bool)
    linked[dst[near]] = True
    begin = np.flatnonzero(~linked)
    run, end = np.cumsum(~linked) - 1, np.append(begin[1:], n)[: len(begin)]
    src, dst = src[~near], dst[~near]
    low = end.copy()
    if not len(src):
        np.minimum.at(low, run[first], first)
    else:
        start, ahead = neighbours(n, src, dst)
        start.append(start[-1])
        run_of, lowest, left = run.tolist(), end.tolist(), first.tolist()
        while left:
            v = left.pop()
            r = run_of[v]
            until = lowest[r]
            if v < until:
                lowest[r] = v
                left += ahead[start[v] : start[until]]
        low = np.array(lowest, np.int64)
    return np.arange(n) >= low[run] if n else np.zeros(0, bool)


def records(group: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which rows are at least the largest before them in their group, at the start 0. Groups come together."""
    out, key, most = [], None, 0
    for g, x in zip(group.tolist(), w.tolist(), strict=True):
        if g != key:
            key, most = g, 0
        out.append(x >= most)
        most = max(most, x)
    return np.array(out, bool)
