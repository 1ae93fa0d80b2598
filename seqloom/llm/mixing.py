"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources that they belong to. A flow carries words from patterns to source quotas;
the k-th pass over a pattern costs k, which is convex, so words are repeated only when fresh ones run out. A pattern's
flow becomes whole passes for all its documents and one more pass for a seeded prefix of them, whose last document may
be taken in part, so quotas are met to the word.

The seeded prefix is found by counting: hash cells per pattern, then finer cells inside the one that the quota ends in,
then a window over that small cell only. No task ever holds a source.

Defined cases: null text has size 0; a null source is a source of its own, last in order; no rows give no rows;
repeated rows count each time. Up to ``max_patterns`` patterns the driver holds sums per pattern and source. More are
tables: targets by aggregate rounds, a pattern that alone has its only source gets that source's quota, and the others go
to a flow for each connected component of sources, a task each; the quotas are the same.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.plans.lineage import connected_components, materialize

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096


def targets(sizes: list[int], weights: list[float], share: float, limit: float) -> list[float]:
    """``share`` of all sizes split by weight; none above ``limit`` times its size, the excess split again by weight."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, x in enumerate(sizes) if x > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = limit * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], passes: int) -> list[list[int]]:
    """Words from each pattern to each of its sources, at least cost; ``passes`` arcs a pattern with costs 0, 1, 2, ...

    Successive shortest paths with potentials over source -> pattern -> quota -> sink.
    """
    n_p, n_q = len(supply), len(quota)
    start, sink = 0, 1 + n_p + n_q
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, c: int, w: int) -> int:
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)
        return len(to) - 2

    for p, size in enumerate(supply):
        for k in range(passes):
            arc(start, 1 + p, size, k)
    use = [[arc(1 + p, 1 + n_p + q, passes * supply[p], 0) for q in own] for p, own in enumerate(members)]
    for q, want in enumerate(quota):
        arc(1 + n_p + q, sink, want, 0)
    height = [0] * (sink + 1)
    while True:
        far: list[int | None] = [None] * (sink + 1)
        came: list[int] = [-1] * (sink + 1)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in arcs[a]:
                if room[e] and (far[to[e]] is None or d + cost[e] + height[a] - height[to[e]] < far[to[e]]):
                    far[to[e]], came[to[e]] = d + cost[e] + height[a] - height[to[e]], e
                    heapq.heappush(heap, (far[to[e]], to[e]))
        if far[sink] is None:
            break
        for a, d in enumerate(far):
            height[a] += far[sink] if d is None else min(d, far[sink])
        path, a = [], sink
        while a != start:
            path.append(came[a])
            a = to[came[a] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return [[room[e ^ 1] for e in own] for own in use]


def source_targets(sources: DataFrame, cycle: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """``targets`` for a table: adds ``idx`` (place by name), ``target`` and ``quota`` to source, source_size."""
    ranked = sources.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    table = materialize(sources.sparkSession.createDataFrame(ranked, "idx long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sources.schema)), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("idx") % len(cycle) + 1).cast("int")).cast("double")
    left = float(share * (table.agg(F.sum("source_size")).first()[0] or 0))
    unit, known = left / max(1e-300, table.where("source_size > 0").agg(F.sum(weight)).first()[0] or 0), -1
    while True:  # the unit only rises, and each round but the last caps another source
        over = weight * unit > limit * F.col("source_size")
        r = table.where("source_size > 0").agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, weight))).first()
        if r[0] == known or not r[2]:
            break
        known, unit = r[0], (left - limit * (r[1] or 0)) / r[2]
    goal = F.when(F.col("source_size") > 0, F.least(weight * unit, F.col("source_size") * float(limit))).otherwise(0.0)
    return materialize(table.withColumn("target", goal).withColumn("quota", F.bround("target").cast("long")), "mix-targets")


def plan_of_tables(sums: DataFrame, cycle: tuple[int, ...], share: float, limit: int) -> DataFrame:
    """pattern, members, full, rest, source_size, target for every row of ``sums`` (members, size), on Spark."""
    sums = materialize(sums.withColumn("pattern", F.monotonically_increasing_id()), "mix-patterns")
    edges = sums.select("pattern", "size", F.size("members").alias("n"), F.explode(F.array_distinct("members")).alias("source"))
    sources = edges.groupBy("source").agg(F.sum("size").alias("source_size"), ((F.count("*") > 1) | (F.max("n") > 1)).alias("shared"))
    goals = source_targets(sources, cycle, share, limit)
    own = goals.withColumnRenamed("source", "own")
    first = sums.join(own, F.element_at("members", 1).eqNullSafe(F.col("own")))
    some = F.greatest("size", F.lit(1))  # without words there is no quota either
    alone = first.where("not shared").select("pattern", F.floor(F.col("quota") / some).alias("full"), (F.col("quota") % some).alias("rest"))
    met = edges.join(own.where("shared"), F.col("source").eqNullSafe(F.col("own")))
    met = materialize(met.select("pattern", "size", "idx", "quota"), "mix-shared")
    names = connected_components(met.join(met.groupBy("pattern").agg(F.min("idx").alias("low")), "pattern"), "low", "idx")
    joined = met.join(names, met["idx"] == names["node"], "left").select("pattern", "size", "idx", "quota", F.coalesce("component", "idx").alias("component"))

    def flows(part: pd.DataFrame) -> pd.DataFrame:
        place = {x: k for k, x in enumerate(sorted(part["idx"].unique()))}
        quota = part.drop_duplicates("idx").sort_values("idx")["quota"].tolist()
        rows = [(p, int(x["size"].iloc[0]), [place[i] for i in sorted(x["idx"])]) for p, x in part.groupby("pattern")]
        words = [sum(x) for x in min_cost_flow([r[1] for r in rows], [r[2] for r in rows], quota, limit)]
        return pd.DataFrame([(p, *(divmod(w, n) if n else (0, 0))) for (p, n, _), w in zip(rows, words, strict=True)], columns=["pattern", "full", "rest"])

    flow = alone.unionByName(joined.groupBy("component").applyInPandas(flows, "pattern long, full long, rest long"))
    return materialize(first.select("pattern", "members", "source_size", "target").join(flow, "pattern"), "mix-plan").select("pattern", "members", "full", "rest", "source_size", "target")


def take(docs: DataFrame, flow: DataFrame, small: bool = True) -> DataFrame:
    """Add ``taken`` to ``docs`` (pattern, size, pick, ...). ``flow``: pattern, full (whole passes), rest (words of one more).

    Both hash levels split a pattern into CELLS cells; of each level only the cell that the quota ends in is split on.
    """
    spark, hint = docs.sparkSession, F.broadcast if small else lambda x: x
    cells = docs.withColumn("c1", F.pmod(F.col("pick"), F.lit(CELLS)).cast("int")).withColumn("c2", F.pmod(F.shiftright("pick", 12), F.lit(CELLS)).cast("int"))

    def ends(frame: DataFrame, cell: str, limits: DataFrame, rest: str) -> DataFrame:
        """Per pattern the cell in which ``rest`` ends, and what is left for it."""
        sums = frame.groupBy("pattern", cell).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).join(limits, "pattern").where(F.col("upto") > F.col(rest))
        return found.groupBy("pattern").agg(F.min(F.struct(cell, (F.col(rest) - F.col("upto") + F.col("words")).alias("left"))).alias("end"))

    one = ends(cells, "c1", flow, "rest").select("pattern", F.col("end.c1").alias("e1"), F.col("end.left").alias("l1"))
    flow1 = materialize(flow.join(one, "pattern", "left"), "mix-cut")
    inside = cells.join(hint(flow1), "pattern").where("c1 = e1").select(*cells.columns)
    two = ends(inside, "c2", flow1, "l1").select("pattern", F.col("end.c2").alias("e2"), F.col("end.left").alias("l2"))
    flow2 = flow1.join(two, "pattern", "left")
    flow2 = spark.createDataFrame(flow2.collect(), "pattern int, full long, rest long, e1 int, l1 long, e2 int, l2 long") if small else materialize(flow2, "mix-ends")
    marked = cells.join(hint(flow2), "pattern")
    before = F.expr("e1 is null or c1 < e1 or (c1 = e1 and (e2 is null or c2 < e2))")
    final = F.expr("c1 = e1 and c2 = e2")
    keep = [c for c in docs.columns]
    upto = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("pick", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    easy = marked.where(~F.coalesce(final, F.lit(False))).withColumn("more", F.when(before, F.col("size")).otherwise(0))
    edge = marked.where(F.coalesce(final, F.lit(False))).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("l2") - upto)))
    return easy.unionByName(edge).select(*keep, (F.col("full") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def mix(
    docs: DataFrame, members: str = "members", cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, seed: int = 23, max_patterns: int = 4096, key: str | None = None
) -> DataFrame:
    """``docs``: doc_id, text and an array column of source names. Returns doc_id, pattern's sources, size, source_size, target, taken."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.col(members).alias("members"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.abs(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))).alias("pick"),
        *([F.xxhash64(key).alias("th")] if key else []),
    )
    rows = materialize(rows, "mix-sizes")
    by_members = rows.groupBy("members").agg(F.sum("size").alias("size"))
    sums = by_members.limit(max_patterns + 1).collect()
    small = len(sums) <= max_patterns
    if small:
        sums.sort(key=lambda r: [(x is None, (x or "").encode()) for x in r.members])
        names = sorted({x for r in sums for x in r.members}, key=lambda x: (x is None, (x or "").encode()))
        size = {x: sum(r["size"] for r in sums if x in r.members) for x in names}
        goal = targets([size[x] for x in names], [cycle[i % len(cycle)] for i in range(len(names))], share, limit)
        flow = min_cost_flow([r["size"] for r in sums], [[names.index(x) for x in r.members] for r in sums], [round(x) for x in goal], limit)
        plan = []
        for k, (r, own) in enumerate(zip(sums, flow, strict=True)):
            full, rest = divmod(sum(own), r["size"]) if r["size"] else (0, 0)
            first = r.members[0]
            plan.append((k, r.members, full, rest, size[first], float(goal[names.index(first)])))
        table = spark.createDataFrame(plan, "pattern int, members array<string>, full long, rest long, source_size long, target double")
    else:
        table = plan_of_tables(by_members, cycle, share, limit)
    hint = F.broadcast if small else lambda x: x
    keyed = rows.join(hint(table.select("pattern", F.col("members").alias("own"))), F.col("members").eqNullSafe(F.col("own"))).drop("own", "members")
    if not small:
        keyed = materialize(keyed, "mix-keyed")
    taken = take(keyed, table.select("pattern", "full", "rest"), small)
    return taken.join(hint(table.select("pattern", "members", "source_size", "target")), "pattern").select("doc_id", "members", "size", "source_size", "target", "taken", *(["th"] if key else []))


def mix_by_source(docs: DataFrame, **options) -> DataFrame:
    """Every document belongs to its own source."""
    return mix(docs.select("doc_id", "text", F.array(F.col("source").cast("string")).alias("members")), **options)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: words taken over size, rounded. Same columns, whatever
    their names.

    Rows with equal doc_id and text are taken alike: by the mean of what the mix takes of them.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_th"))
    mixed = mix(docs.select("doc_id", "text", F.array(F.col("source").cast("string")).alias("members")), key="text", **options)
    times = mixed.groupBy("doc_id", "th").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).select("doc_id", "th", F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int").alias("times")).where("times > 0")
    met = own.join(times.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_t"), F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_th").eqNullSafe(F.col("_t")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).select("own.*")
