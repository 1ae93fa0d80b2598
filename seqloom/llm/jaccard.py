"""N-gram Jaccard join with rare-first prefixes.

A document is the set of its word n-grams, hashed to 56 bits below a byte that tells how frequent the n-gram's counter
is: sorting these tokens puts rare ones first. Two sets of the wanted similarity share a token among the first
``n - ceil(t * n) + 1`` of both, so only documents that share such a prefix token are compared, after filters on length
and on position and a suffix filter on coarse histograms of the sets, and each pair once.

Counters cover all documents: a sketch of ``2 ** SKETCH`` counts, summed over tasks in a tree and broadcast as one byte
a counter (4 MB at any corpus size). They steer the order only; results do not depend on them.

Groups are not expanded into pairs. Documents with the same set are one node. A token's documents are joined to single
centres (one row each), what is linked is one component, and tokens whose documents are all in one component go. Centre
rounds repeat with other centres while they find links and the pairs that are left are more than ``spread`` times the
rows; then documents of different components are paired under each token that is left, the smaller set by its earlier
tokens only. Every pair that could link two components is thus verified.

Defined cases: null or empty texts and texts without words have the empty set and link with nothing; shorter texts than
an n-gram are one n-gram; documents without a doc_id link with nothing and have a null component; repeated rows are
copies of one node; rows that share a doc_id but not the text are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.marks import Bitmap, look_up, maybe_in
from seqloom.plans.lineage import connected_components, discard, materialize

SKETCH, CHUNKS, FAN_IN, BINS = 22, 64, 64, 256
SLICE = 1 << 18  # bytes of text that are hashed at a time

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE = np.random.default_rng(1).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
BASE = 0x5851F42D4C957F2D
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Shingler:
    """Hashes of the distinct word n-grams of texts, many texts at a time."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.up = powers(BASE, 2 * SLICE)
        self.down = powers(pow(BASE, -1, 1 << 64), 2 * SLICE)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text."""
        out, at = [], 0
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        while at < len(data):
            to, size = at, 0
            while to < len(data) and (to == at or size + len(data[to]) <= SLICE):
                size += len(data[to]) + 1
                to += 1
            out += self._sets(data[at:to], size)
            at = to
        return out

    def _sets(self, data: list[bytes], size: int) -> list[np.ndarray]:
        if size + 1 > len(self.up):
            self.up, self.down = powers(BASE, 2 * size), powers(pow(BASE, -1, 1 << 64), 2 * size)
        text = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
        space = SPACE[text]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        value = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(BYTE[text] * self.up[: len(text)], out=value[1:])
        words = mixed((value[ends] - value[starts]) * self.down[starts])
        borders = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
        first = np.searchsorted(starts, borders + 1)
        run = words[: max(0, len(words) - self.k + 1)].copy()
        for j in range(1, self.k):
            run = run * M2 + words[j : len(words) - self.k + 1 + j]
        run = mixed(run)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= self.k:
                out.append(np.unique(run[a : b - self.k + 1]))
            elif b > a:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = h * M2 + w
                out.append(mixed(h))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, th: a row is known by its id and its text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def frequency_bytes(docs: DataFrame, k: int) -> np.ndarray:
    """For each counter of the sketch a byte that grows with the logarithm of its count over all documents."""
    width = (1 << SKETCH) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, total = Shingler(k), np.zeros(1 << SKETCH, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = shingler.sets(batch.column(0).slice(at, 512).to_pylist())
                own, n = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH), return_counts=True) if sets else (np.zeros(0, np.uint64), 0)
                total[own.astype(np.int64)] += np.asarray(n, np.uint32)
        blobs = [zlib.compress(x.tobytes(), 1) for x in total.reshape(CHUNKS, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([TaskContext.get().partitionId()] * CHUNKS, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "part", "blob"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint64)
        for blob in pdf["blob"]:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        own = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "part": [pdf["part"].iloc[0]], "blob": [zlib.compress(own.tobytes(), 1)]})

    parts = materialize(texts_of(docs).select("text").mapInArrow(count, "chunk int, part int, blob binary"), "sketch")
    while True:
        parts = materialize(parts.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("chunk", "part").applyInPandas(add, parts.schema), "sketch")
        if not parts.agg(F.max("part")).first()[0]:
            break
    out = np.zeros((CHUNKS, width), np.uint8)
    for r in parts.toLocalIterator():
        out[r.chunk] = np.minimum(255, 8 * np.log2(1 + np.frombuffer(zlib.decompress(bytes(r.blob)), np.uint32).astype(np.float64)))
    return out.reshape(-1)


def tokens(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorted tokens: the frequency byte above 56 bits of the hash."""
    high = rank[(hashes >> np.uint64(64 - SKETCH)).astype(np.int64)].astype(np.uint64)
    return np.sort((high << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1)))


def needed(n: int, m: int, num: int, den: int) -> int:
    """The least intersection of sets of n and m whose similarity is num / den."""
    return -(-num * (n + m) // (num + den))


def histogram(own: np.ndarray) -> bytes:
    """How many tokens fall into each of BINS bins, up to 15, two bins a byte."""
    n = np.minimum(np.bincount((own & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 15).astype(np.uint8)
    return (n[0::2] << 4 | n[1::2]).tobytes()


def signed(docs: DataFrame, k: int, num: int, den: int, rank) -> DataFrame:
    """(doc_id, th, row, n, digest of the set, prefix tokens, histogram of the set). ``row`` numbers the rows as they are written."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, row = Shingler(k), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [tokens(h, rank.value) for h in shingler.sets(part.column(1).to_pylist())]
                n = [len(x) for x in sets]
                prefixes = [x[: len(x) - -(-num * len(x) // den) + 1 if len(x) else 0].view(np.int64) for x in sets]
                bins = [histogram(x) for x in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in prefixes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(range(row, row + len(sets)), pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(bins, pa.binary())],
                    names=["doc_id", "th", "row", "n", "digest", "prefix", "bins"],
                )
                row += len(sets)

    return texts_of(docs).mapInArrow(sign, "doc_id long, th long, row long, n long, digest binary, prefix array<long>, bins binary")


def full_sets(docs: DataFrame, asked: DataFrame, k: int, rank) -> DataFrame:
    """(node, tokens) of the asked rows (node, doc_id, th), hashed anew: nothing of the others is kept or moved."""
    marked = Bitmap(asked, "doc_id", "th")
    bits = marked.bits

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        for batch in batches:
            batch = batch.filter(pa.array(look_up(bits.value, batch.column(3).to_numpy().astype(np.int64))))
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            new = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]  # of repeated rows one a task
            batch = batch.take(pa.array(new, pa.int64()))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [tokens(h, rank.value).tobytes() for h in shingler.sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, pa.binary())], names=["doc_id", "th", "tokens"])

    own = texts_of(docs).where("doc_id is not null").withColumn("bit", marked.bit())
    return own.mapInArrow(sets_of, "doc_id long, th long, tokens binary").join(asked, ["doc_id", "th"]).select("node", "tokens")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int, rank) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Only the sets of documents in pairs move."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            s, t = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(s) > len(t):
                s, t = t, s
            both = int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)) if len(s) else 0
            out.append(both > 0 and den * both >= num * (len(s) + len(t) - both))
        return pd.Series(out)

    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialize(nodes.join(ends, "node", "left_semi").select("node", "doc_id", "th"), "asked")
    sets = materialize(full_sets(docs, asked, k, rank), "sets")
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    links = materialize(two.where(similar("x", "y")).select("a", "b").distinct(), "links")
    discard(asked, sets)
    return links


def filtered(pairs: DataFrame, shapes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs that pass the length filter and the suffix filter: histograms that differ by more than allowed."""

    @F.pandas_udf("long")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        p, q = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, BINS // 2) for c in (x, y))
        out = np.zeros(len(p), np.int64)
        for k in (p >> 4, q >> 4), (p & 15, q & 15):
            one, two = (v.astype(np.int16) for v in k)
            out += np.where((one == 15) | (two == 15), 0, np.abs(one - two)).sum(1)
        return pd.Series(out)

    a, b = (shapes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"bins{x}")) for x in "ab")
    close = pairs.distinct().join(a, "a").join(b, "b").where(F.col("na") * den >= F.col("nb") * num).where(F.col("nb") * den >= F.col("na") * num)
    least = F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))
    return close.where(apart("binsa", "binsb") <= F.col("na") + F.col("nb") - 2 * least).select("a", "b")


def crowded(own: DataFrame, spread: int) -> bool:
    """Whether the pairs of different components under tokens are more than ``spread`` times the rows."""
    sized = own.groupBy("token", "component").agg(F.count("*").cast("double").alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    rows, pairs = sized.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
    return bool(rows) and pairs > spread * rows


def link_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, centre_rounds: int = 8, spread: int = 64) -> DataFrame:
    """One row per document: doc_id, th, n_shingles, component_id, and ``first``: whether its component is named by its id and text."""
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(frequency_bytes(docs, k))
    marks = materialize(signed(docs, k, num, den, rank), "signed")
    real = marks.where("n > 0 and doc_id is not null")
    nodes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "th", "row")).alias("r"), F.count("*").alias("rows"))
    nodes = materialize(nodes.select("digest", "r.doc_id", "r.th", F.col("r.row").alias("node"), "rows"), "nodes")
    again = real.select("row", "digest").join(nodes.where("rows > 1").select("digest", "node"), "digest").where("row <> node")
    again = materialize(again.select("row"), "copies")
    # only rows that a bitmap cannot clear of being copies meet the copies
    maybe = maybe_in(again, "row")
    unique = real.select("row", "n", "prefix", maybe.alias("maybe"))
    unique = unique.where("not maybe").unionByName(unique.where("maybe").join(again, "row", "left_anti"))
    # a token matters if two sets have it among their first, and one of them so early that it can be the smaller of a pair
    early = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * num) * F.col("n") / F.lit(num + den))
    posting = unique.select(F.col("row").alias("node"), "n", F.posexplode("prefix").alias("pos", "token"))
    shared = posting.groupBy("token").agg(F.count("*").alias("sets"), F.max(early).alias("early")).where("sets > 1 and early").select("token")
    # tables of their own let joins split what very many documents have; the same kind of join at every size
    shared = materialize(shared, "tokens")
    at = F.col("at")
    own = posting.select("token", "node", (F.shiftleft("n", 24) + F.col("pos")).alias("at")).join(shared.hint("merge"), "token")
    own = own.select("token", "node", F.shiftright(at, 24).alias("n"), at.bitwiseAND((1 << 24) - 1).alias("pos"), F.col("node").alias("component"))
    own = materialize(own, "lists")
    shapes = materialize(real.select(F.col("row").alias("node"), "n", "bins").join(own.select("node").distinct(), "node", "left_semi"), "shapes")
    digests = materialize(marks.select("doc_id", "th", "n", "digest"), "digests")
    discard(marks, shared, again)
    links, tried, component, merged = None, None, None, True
    sides = ("node", "n", "pos", "component")

    def side(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}{k}") for c in sides))

    def first_common(met: DataFrame) -> DataFrame:
        """Pairs whose first common token this can be: no more of either set follows it than the least intersection."""
        both = F.ceil(F.lit(num) * (F.col("n1") + F.col("n2")) / F.lit(num + den))
        fits = (F.col("pos1") <= F.col("n1") - both) & (F.col("pos2") <= F.col("n2") - both)
        return met.where("component1 <> component2").where(fits).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))

    for r in range(centre_rounds + 1):
        # the centre of a token: first the document with the least share of rarer tokens, later one by hash
        turn = F.xxhash64("node", F.lit(r)) if r else F.col("pos") / F.col("n")
        centre = own.groupBy("token").agg(F.min(F.struct(turn.alias("turn"), *sides)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        centre = materialize(centre.select("token", "c.*").drop("turn"), "centres")
        if r:  # under the other tokens all are linked by now
            mixed = materialize(own.join(centre.select("token"), "token"), "lists")
            discard(own)
            own = mixed
        last = r == centre_rounds or (r > 0 and not (merged and crowded(own, spread)))
        if last:  # all pairs of different components under a token, the smaller set first
            ordered = F.struct("n1", "node1") < F.struct("n2", "node2")
            met = side(own.where(early), 1).join(side(own, 2), "token").where(ordered)
        else:
            met = side(own, 1).join(side(centre, 2), "token")
        pairs = filtered(first_common(met), shapes, num, den)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        discard(centre)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(pairs, nodes, docs, k, num, den, rank)
        links = found if links is None else links.unionByName(found)
        merged = not found.isEmpty()
        if merged or component is None:
            discard(component)
            component = connected_components(links)
        if last:
            break
        moved = own.drop("component").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        moved = materialize(moved, "lists")
        discard(own)
        own = moved
    placed = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("name"))
    placed = materialize(placed.join(names, "component").select("digest", "name"), "placed")
    discard(own, shapes, nodes, component)
    rest = digests.where("n > 0 and doc_id is not null").join(placed, "digest").select("doc_id", "th", "n", F.col("name.doc_id").alias("component_id"), (F.struct("doc_id", "th") == F.col("name")).alias("first"))
    alone = digests.where("n = 0 or doc_id is null").select("doc_id", "th", "n", F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"), F.lit(True).alias("first"))
    return rest.unionByName(alone).withColumnRenamed("n", "n_shingles")


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return link_rows(docs, k, num, den, **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the smallest doc_id (of one doc_id, the text with the smallest hash) of each component. Same columns.

    Rows without a doc_id or without words stay; of rows that repeat a doc_id and its text one stays. Only rows that a
    bitmap cannot clear meet in a join.
    """
    links = materialize(link_rows(docs, **options), "linked")
    gone = links.where("not first").select("doc_id", "th").distinct()
    again = links.where("doc_id is not null").groupBy("doc_id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id", "th")
    asked = materialize(gone.withColumn("gone", F.lit(True)).unionByName(again.join(gone, ["doc_id", "th"], "left_anti").withColumn("gone", F.lit(False))), "asked")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    clear = F.col("doc_id").isNull() | ~maybe_in(asked, "doc_id", "th")
    kept = rows.where(~clear).join(asked, ["doc_id", "th"], "left").where("gone is null or not gone")
    kept = kept.where("gone is null").select("own").unionByName(kept.where("not gone").dropDuplicates(["doc_id", "th"]).select("own"))
    return rows.where(clear).select("own").unionByName(kept).select("own.*")
