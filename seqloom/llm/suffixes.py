"""Exact substring dedup with suffix arrays.

Every byte that lies in a ``WINDOW``-byte string which also starts elsewhere is removed. The work goes to shards so that
all occurrences of a string meet, whatever document they are in:

1. A string's anchor is the least hash of its GRAM-byte grams, a function of its content. Windows in a row with the same
   anchor form a fragment. An anchor that occurs once and does not repeat inside its fragment holds no repeated window,
   and its text goes no further. Equal fragments are folded: of two or more, all bytes are covered.
2. The other distinct fragments go to shards by anchor, at most about ``shard_bytes`` each. A shard sorts its suffixes by
   Larsson-Sadakane refinement (groups that are still tied are sorted by the rank that lies the sorted depth ahead) and
   takes the common prefixes of neighbours by Kasai's method, run in many lanes; a prefix of WINDOW bytes is a repeat.
3. An anchor with more text than MOST_PARTS shards hold is narrowed first: its windows are told apart by where the anchor
   lies in them, in two halves of the offsets at a time, and by the hash of the bytes that all windows of a half have
   around it. Equal windows stay together, and a window is in one class only; at a single offset a class is one string,
   so that narrowing ends after as many rounds as the logarithm of the window.
4. A class with more text than a shard holds is cut into up to MOST_PARTS shards, each of which is also merged with each
   other one by binary search of its windows in the other's suffix array.

Covered spans meet their documents again; documents that no span can concern (a bitmap tells) do not shuffle.

Passages that other documents have too are found by the same steps over words, each laid as its 64-bit hash: a window is then
a number of words, however few bytes they have. Windows that come again in their own document take part once, so that what
repeats is in another document; they are marked afterwards. Nothing is removed for a passage, it is only counted.

Defined cases: null texts are empty; texts shorter than a window keep everything; overlapping repeats count; repeated
rows are copies of each other; a null doc_id is kept as one. Words are what the white space of ASCII divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from seqloom.llm.marks import maybe_in
from seqloom.plans.lineage import discard, materialize

WINDOW, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 51, 16  # the same over words
MOST_WINDOWS = 8192  # of a fragment; longer runs are periodic
MOST_PARTS = 4  # shards that a class is merged over pairwise
STOP = 0xFF  # never a byte of UTF-8; eight of them are no word
LONG = 64  # bytes of a word from which xxhash takes it

RNG = np.random.default_rng(2)
BYTE = RNG.integers(1 << 63, size=256, dtype=np.uint64)
STEPS = [np.uint64(int(x) | 1) for x in RNG.integers(1 << 62, size=8)]
PLACED = RNG.integers(1 << 64, size=(LONG + 1, 256), dtype=np.uint64)
PLACED[:, [9, 10, 11, 12, 13, 32]] = 0
PLACED = PLACED.ravel()


def word_codes(data: bytes) -> np.ndarray:
    """The words of UTF-8 text as 64-bit hashes: sums of a random number for each byte at each place in the word."""
    text = np.frombuffer(data, np.uint8)
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = (text == 32) | (text - np.uint8(9) < 5)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    text = text[starts[0] :]
    at = np.arange(len(text)) - np.repeat(starts - starts[0], np.diff(starts, append=len(text) + starts[0]))
    codes = np.add.reduceat(PLACED[(np.minimum(at, LONG) << 8) | text], starts - starts[0])
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        codes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return np.minimum(codes, np.uint64((1 << 64) - 2))


def symbols(data: bytes, unit: int) -> np.ndarray:
    """Bytes, or words of ``unit`` 8."""
    return np.frombuffer(data, np.uint8 if unit == 1 else np.uint64)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams (a power of two long), by doubling."""
    h, n = BYTE[text] if text.dtype == np.uint8 else text, 1
    for c in STEPS:
        if n == gram:
            break
        h = h[:-n] * c + h[n:]
        n *= 2
    h = (h ^ (h >> np.uint64(31))) * STEPS[7]
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """From the hashes of two grams that cover the window."""
    n, gram = len(codes) - window + 1, 1 << (window.bit_length() - 1)
    g = gram_hashes(codes, gram)
    return g[:n] * STEPS[0] + g[window - gram :]


def fragments(data: bytes, window: int = WINDOW, gram: int = GRAM, unit: int = 1) -> list[tuple[int, int, int, int, bool]]:
    """(start, windows, anchor, digest, whether the anchor repeats inside) of the fragments of a text.

    Of words, windows that have come before in the text are left out, and no anchor counts as repeated inside.
    """
    if len(data) < window * unit:
        return []
    text = symbols(data, unit)
    g = gram_hashes(text, gram)
    m = sliding_min(g, window - gram + 1)
    same = m[1:] == m[:-1]
    starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
    inside = np.append(same & (g[: len(m) - 1] == m[:-1]), False)
    again = np.add.reduceat(inside.astype(np.int32), starts) > 0
    if unit > 1:
        if again.any() or len(np.unique(m[starts])) < len(starts):
            fresh = np.zeros(len(m), bool)
            fresh[np.unique(window_hashes(text, window), return_index=True)[1]] = True
            starts = np.concatenate([[0], np.flatnonzero(~same | (fresh[1:] != fresh[:-1])) + 1])
        else:
            fresh = np.ones(len(m), bool)
        again = np.zeros(len(starts), bool)
    ends = np.append(starts[1:], len(m))
    if unit > 1:
        starts, ends, again = starts[fresh[starts]], ends[fresh[starts]], again[fresh[starts]]
    anchors = m[starts].view(np.int64)
    out = []
    for a, b, anchor, repeat in zip(starts.tolist(), ends.tolist(), anchors.tolist(), again.tolist(), strict=True):
        for s in range(a, b, MOST_WINDOWS):
            w = min(MOST_WINDOWS, b - s)
            out.append((s, w, anchor, xxhash.xxh3_64_intdigest(data[s * unit : (s + w - 1 + window) * unit]) - (1 << 63), repeat))
    return out


def narrower(data: bytes, windows: int, anchor: int, at: int | None, low: int, high: int, window: int, gram: int, unit: int = 1) -> list[tuple[int, int, int, int, int, int, int]]:
    """(start, windows, anchor's place, low, high, class, digest) of a fragment's parts in both halves of the offsets.

    An offset is the distance from a window's start to the first place of its anchor; ``at`` is that place where the
    fragment has been narrowed before.
    """
    if at is None:
        places = np.flatnonzero(gram_hashes(symbols(data, unit), gram).view(np.int64) == anchor).tolist()
    else:
        places = [at]
    middle, out, before = (low + high + 1) // 2, [], -1
    for place in places:
        for lo, hi in ((low, middle - 1), (middle, high)):
            s, last = max(before + 1, place - hi), min(place - lo, windows - 1)
            if lo <= hi and s <= last:
                core = data[(place - lo) * unit : (place + window - hi) * unit]
                out.append((s, last - s + 1, place - s, lo, hi, xxhash.xxh3_64_intdigest(core, seed=lo * window + hi) - (1 << 63), xxhash.xxh3_64_intdigest(data[s * unit : (last + window) * unit]) - (1 << 63)))
        before = place
    return out


def packed(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros behind the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out, n = wide, 1
    for shift in (8, 16, 32):
        out = (out[:-n] << np.uint64(shift)) | out[n:]
        n *= 2
    return out[: len(text)]


def suffix_ranks(words: np.ndarray, step: int, depth: float) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order of their first ``depth`` symbols, rank of each, ties alike), by Larsson-Sadakane refinement.

    A position's number holds ``step`` symbols: eight packed bytes, or one word.
    """
    n = len(words)
    order = np.argsort(words)
    new = np.append(True, words[order][1:] != words[order][:-1])
    rank = np.zeros(n + 1, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))  # of groups that are still tied
    h = step
    while len(slots) and h < depth:
        own = order[slots]
        ahead = rank[np.minimum(own + h, n)]
        group = rank[own]
        by = np.argsort(group * (n + 1) + ahead)
        own, ahead, group = own[by], ahead[by], group[by]
        order[slots] = own
        new = np.append(True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1]))
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[own] = first + 1
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order, rank


def suffix_array(words: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes in order, place of each). Refined until no group is tied, as Kasai's method needs."""
    order, rank = suffix_ranks(words, step, np.inf)
    return order, rank[: len(words)] - 1


def equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many leading bytes of two packed words agree."""
    z = x ^ y
    return sum((z < np.uint64(1 << s)).astype(np.int64) for s in (56, 48, 40, 32, 24, 16, 8)) + (z == 0)


def common_prefixes(words: np.ndarray, order: np.ndarray, place: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Bytes (up to ``most``) that each suffix shares with the one before it in the order: Kasai's method, a lane at a time."""
    n = len(words)
    before = np.where(place > 0, order[np.maximum(place - 1, 0)], -1)
    tail = np.concatenate([words, np.zeros(most + 8, np.uint64)])
    out, h = np.zeros(n, np.int64), np.zeros(-(-n // lane), np.int64)
    for k in range(min(lane, n)):
        p = np.arange(k, n, lane)
        j, h = before[p], np.maximum(h[: len(p)] - 1, 0)
        h[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            a, b = p[live] + h[live], j[live] + h[live]
            same = equal_bytes(tail[a], tail[b])
            same = np.minimum(same, n - np.maximum(a, b))
            h[live] += same
            live = live[(same == 8) & (h[live] < most)]
        h = np.minimum(h, most)
        out[p] = h
    return out


class Shard:
    """Fragments laid end to end, a stop symbol after each, and their suffix array."""

    def __init__(self, parts: list[bytes], counts: list[int], window: int, unit: int = 1) -> None:
        self.window, self.parts, self.counts = window, parts, counts
        text = symbols(b"".join(x + bytes([STOP]) * unit for x in parts), unit)
        self.starts = np.concatenate([[0], np.cumsum([len(x) // unit + 1 for x in parts])])[:-1].astype(np.int64)
        self.words, self.step = (packed(text), 8) if unit == 1 else (text, 1)
        self.gap = window if unit == 1 else 1  # spans of words tell which windows are meant
        self.tail = np.concatenate([self.words, np.zeros(window + 8, np.uint64)])
        self.is_window = np.zeros(len(text), bool)
        for s, w in zip(self.starts.tolist(), counts, strict=True):
            self.is_window[s : s + w] = True

    @cached_property
    def order(self) -> np.ndarray:
        return suffix_array(self.words, self.step)[0]

    def repeated(self) -> np.ndarray:
        """Which positions start a window that starts at another position too.

        Windows of words are equal where their first and last symbols are, a power of two of them, and so have equal ranks at that depth.
        """
        n = len(self.words)
        if self.step == 1:
            depth = 1 << (self.window.bit_length() - 1)
            rank, own, out = suffix_ranks(self.words, 1, depth)[1], np.flatnonzero(self.is_window), np.zeros(n, bool)
            _, kind, count = np.unique(rank[own] * (n + 1) + rank[own + self.window - depth], return_inverse=True, return_counts=True)
            out[own] = count[kind] > 1
            return out
        order, place = suffix_array(self.words)
        low = common_prefixes(self.words, order, place, self.window)
        hit = low >= self.window
        after = np.zeros(n, bool)
        after[order[:-1]] = hit[order[1:]]
        return (hit | after) & self.is_window

    def found_in(self, other: Shard) -> np.ndarray:
        """Which positions start a window that starts in the other shard: binary search in its suffix array."""
        own = np.flatnonzero(self.is_window)
        theirs = other.order[other.is_window[other.order]]
        out = np.zeros(len(self.words), bool)
        if not len(own) or not len(theirs):
            return out
        lo, hi = np.zeros(len(own), np.int64), np.full(len(own), len(theirs), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            sign = self._compare(own, other, theirs[np.minimum(mid, len(theirs) - 1)])
            right = (lo < hi) & (sign > 0)
            hi = np.where((lo < hi) & ~right, mid, hi)
            lo = np.where(right, mid + 1, lo)
        at = np.minimum(lo, len(theirs) - 1)
        out[own] = (lo < len(theirs)) & (self._compare(own, other, theirs[at]) == 0)
        return out

    def _compare(self, own: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """Sign of own minus theirs over a window."""
        sign, live = np.zeros(len(own), np.int8), np.arange(len(own))
        for at in range(0, self.window, self.step):
            a, b = self.tail[own[live] + at], other.tail[theirs[live] + at]
            if self.window - at < self.step:
                cut = np.uint64(8 * (8 - self.window + at))
                a, b = a >> cut, b >> cut
            sign[live] = np.where(a > b, 1, np.where(a < b, -1, 0))
            live = live[a == b]
            if not len(live):
                break
        return sign

    def spans(self, hit: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Covered spans of fragment k, from its start."""
        own = np.flatnonzero(hit[self.starts[k] : self.starts[k] + self.counts[k]])
        if not len(own):
            return []
        cut = np.flatnonzero(np.diff(own) > self.gap)
        return list(zip(own[np.append(0, cut + 1)].tolist(), (own[np.append(cut, len(own) - 1)] + self.window).tolist(), strict=True))


def documents_by_row(docs: DataFrame) -> DataFrame:
    """doc_id, doc (not null), text, th: a row is known by its id and its text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), text.alias("text"), F.xxhash64(text).alias("th"))


def narrowed(rows: DataFrame, window: int, gram: int, most: int, unit: int = 1) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each round over classes of more than ``most`` symbols: spans that are known to repeat, and classes that are small now.

    ``rows`` are distinct fragments with their bytes: doc, th, s, w, n, anchor (or class), at, low, high, piece.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                out = []
                for doc, th, start, w, n, anchor, at, low, high, piece in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns), strict=True):
                    first: dict[tuple[int, int], int] = {}
                    for s, count, place, lo, hi, key, digest in narrower(piece, w, anchor, at, low, high, window, gram, unit):
                        known = first.setdefault((key, digest), len(out))
                        row = [doc, th, start + s, count, n, key, digest, place, lo, hi, piece[s * unit : (s + count - 1 + window) * unit]]
                        if known < len(out):  # periodic text: the bytes go along once
                            row[4], row[10] = 2, None
                            out[known][4] = 2
                        out.append(row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    schema = "doc long, th long, s int, w int, n long, anchor long, digest long, at int, low int, high int, piece binary"
    names = [x.split()[0] for x in schema.split(", ")]
    while True:
        parts = materialize(rows.mapInArrow(split, schema), "narrower")
        folded = parts.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("piece").isNull().alias("bare"), "doc", "th", "s", "w")).alias("first"))
        folded = materialize(folded.select("anchor", "digest", "n", "first.doc", "first.th", "first.s", "first.w"), "narrower-folded")
        again = folded.where("n > 1").select("anchor", "digest")
        hits = materialize(parts.join(again, ["anchor", "digest"]).select("doc", "th", F.col("s").alias("a"), (F.col("s") + F.col("w") - 1 + window).alias("b")), "narrower-hits")
        classes = folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum(F.col("w") + window).cast("long").alias("bytes"))
        asked = folded.join(classes.where("kinds > 1 and least = 1").select("anchor", "bytes"), "anchor").drop("w")
        left = materialize(parts.drop("n").join(asked, ["anchor", "digest", "doc", "th", "s"]), "classes")
        discard(parts, folded)
        yield hits, left.where(F.col("bytes") <= most).select("doc", "th", "s", "w", "n", "anchor", "digest", "bytes", "piece")
        rows = left.where(F.col("bytes") > most).select("doc", "th", "s", "w", "n", "anchor", "at", "low", "high", "piece")
        if rows.isEmpty():
            return


def covered(docs: DataFrame, window: int, gram: int, shard_bytes: int, unit: int = 1) -> DataFrame:
    """(doc, th, a, b): spans of bytes (words, if ``unit`` is 8) that repeated windows cover."""

    def laid(x: str) -> bytes:
        return x.encode("utf-8", "surrogatepass") if unit == 1 else word_codes(x.encode("utf-8", "surrogatepass")).tobytes()

    @F.pandas_udf(BinaryType())
    def coded(text: pd.Series) -> pd.Series:
        return text.map(laid)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                doc, th, text = (c.to_pylist() for c in batch.slice(at, 512).columns)
                rows = [(d, t, *f) for d, t, x in zip(doc, th, text, strict=True) for f in fragments(laid(x), window, gram, unit)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "th", "s", "w", "anchor", "digest", "again"])

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
    every = docs.where(F.octet_length("text") >= window).select("doc", "th", "text").mapInArrow(cut, "doc long, th long, s int, w int, anchor long, digest long, again boolean")
    every = materialize(every, "fragments")
    shared = every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("self")).where("n > 1 or self").select("anchor")
    # a table of its own lets the join split an anchor that very many fragments have
    some = materialize(every.join(materialize(shared, "anchors"), "anchor"), "shared")
    folded = some.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "s", "w")).alias("first"), F.max("again").alias("again"))
    folded = materialize(folded.select("anchor", "digest", "n", "again", "first.*"), "folded")
    whole = some.join(folded.where("n > 1").select("anchor", "digest"), ["anchor", "digest"]).select("doc", "th", F.col("s").alias("a"), (F.col("s") + F.col("w") - 1 + window).alias("b"))

    per_anchor = folded.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.max(F.col("again") & (F.col("n") == 1)).alias("self"), F.sum(F.col("w") + window).alias("bytes"))
    asked = folded.join(per_anchor.where("(kinds > 1 and least = 1) or self"), "anchor")
    asked = materialize(asked.select("anchor", "digest", "n", "doc", "th", "s", "w", "bytes"), "asked")
    half = shard_bytes // 2
    small = asked.where(F.col("bytes") <= MOST_PARTS * half)
    large = asked.where(F.col("bytes") > MOST_PARTS * half)

    def pieces(wanted: DataFrame) -> DataFrame:
        own = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("s", "w", "anchor", "digest", "n", "bytes")).alias("own"))
        texts = docs.where(maybe_in(wanted, "doc", "th")).select("doc", "th", (F.encode("text", "UTF-8") if unit == 1 else coded("text")).alias("data")).dropDuplicates(["doc", "th"])
        cut_out = texts.join(own, ["doc", "th"]).select("doc", "th", "data", F.explode("own").alias("f")).select("doc", "th", "data", "f.*")
        return cut_out.select("doc", "th", "s", "w", "n", "anchor", "digest", "bytes", F.expr(f"substring(data, {unit} * s + 1, {unit} * (w - 1 + {window}))").alias("piece"))

    def bytes_of(df: DataFrame) -> int:
        return df.agg(F.coalesce(F.sum(F.col("w") + window), F.lit(0))).first()[0]

    ready, total = pieces(small), bytes_of(small)
    if not large.isEmpty():
        rows = pieces(large).select("doc", "th", "s", "w", "n", "anchor", F.lit(None).cast("int").alias("at"), F.lit(0).alias("low"), F.lit(window - gram).alias("high"), "piece")
        for hits, classes in narrowed(rows, window, gram, MOST_PARTS * half, unit):
            whole, ready, total = whole.unionByName(hits), ready.unionByName(classes), total + bytes_of(classes)
    shards = max(1, -(-total // half))
    parted = ready.withColumn("cuts", F.greatest(F.lit(1), F.ceil(F.col("bytes") / half)).cast("int")).withColumn("part", F.pmod("digest", F.col("cuts")).cast("int"))
    # one shard for a bucket of anchors; for a class that is cut, each part alone and each pair of parts
    one = F.expr("array(struct(part as i, part as j, 0 as side))")
    more = F.expr("concat(transform(sequence(part, cuts - 1), x -> struct(part as i, x as j, 0 as side)), filter(transform(sequence(0, part), x -> struct(x as i, part as j, 1 as side)), x -> x.i < x.j))")
    sharded = parted.withColumn("place", F.explode(F.when(F.col("cuts") == 1, one).otherwise(more))).select("doc", "th", "s", "w", "n", "piece", F.when(F.col("cuts") == 1, F.pmod("anchor", F.lit(shards))).otherwise(F.col("anchor")).alias("shard"), F.col("cuts").alias("cut"), "place.*")

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == k].reset_index(drop=True) for k in (0, 1)]
        built = [Shard(list(x["piece"]), x["w"].tolist(), window, unit) for x in sides if len(x)]
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            hits = [built[0].repeated()]
        else:
            hits = [built[0].found_in(built[1]), built[1].found_in(built[0])] if len(built) == 2 else []
        rows = [(d, t, s + a, s + b) for x, sh, hit in zip(sides, built, hits, strict=False) for k, (d, t, s, n) in enumerate(zip(x["doc"], x["th"], x["s"], x["n"], strict=True)) if n == 1 for a, b in sh.spans(hit, k)]
        return pd.DataFrame(rows, columns=["doc", "th", "a", "b"])

    merged = sharded.groupBy("shard", "cut", "i", "j").applyInPandas(match, "doc long, th long, a int, b int")
    return whole.unionByName(merged)


def passages(data: bytes, spans: list[tuple[int, int]], window: int) -> tuple[int, int]:
    """(maximal runs, words in them) of the windows in ``spans``, wherever they are in the text of these bytes."""
    codes = word_codes(data)
    own = window_hashes(codes, window)
    hit, cover = np.zeros(len(own), bool), np.zeros(len(codes) + 1, np.int64)
    for a, b in spans:
        hit[a : b - window + 1] = True
    hit = np.flatnonzero(np.isin(own, own[hit]))
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    inside = np.cumsum(cover) > 0
    return int(np.count_nonzero(np.diff(np.append(False, inside).astype(np.int8)) == 1)), int(inside.sum())


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = 4_000_000, keep: bool = True, passage: int | None = None, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep``, kept (the bytes left).

    With ``passage`` also n_passages and n_passage_words: maximal runs of words that strings of so many words cover which other
    documents have too, and the words in them.
    """
    own = documents_by_row(docs)
    spans = covered(own, window, gram, shard_bytes).withColumn("words", F.lit(False))
    if passage:
        spans = spans.unionByName(covered(own, passage, passage_gram, shard_bytes, unit=8).withColumn("words", F.lit(True)))
    spans = materialize(spans.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b", "words")).alias("spans")), "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, at, removed, runs = [], 0, 0, 0
                for a, b in sorted((x["a"], x["b"]) for x in found or [] if not x["words"]):
                    if a > at or not runs:
                        kept.append(data[at:a])
                        runs += 1
                    else:
                        a = at
                    removed += max(0, b - a)
                    at = max(at, b)
                left = b"".join(kept) + data[at:]
                shared = [(x["a"], x["b"]) for x in found or [] if x["words"]]
                counts = (passages(data, shared, passage) if shared else (0, 0)) if passage else ()
                rows.append((doc_id, len(data), removed, runs, hashlib.sha256(left).hexdigest(), *counts, *[left] * keep))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), out, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    out = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * (2 * bool(passage)) + [pa.binary()] * keep
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passages long, n_passage_words long" * bool(passage) + ", kept binary" * keep
    marked = own.withColumn("marked", maybe_in(spans, "doc", "th")).withColumn("data", F.encode("text", "UTF-8"))
    touched = marked.where("marked").select("doc_id", "doc", "th", "data").join(spans, ["doc", "th"], "left").select("doc_id", "data", "spans")
    clean = marked.where("not marked").select("doc_id", "data", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return touched.mapInArrow(finish, schema).unionByName(clean.mapInArrow(finish, schema))
