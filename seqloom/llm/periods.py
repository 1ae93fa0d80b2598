"""Periodic runs of words: maximal stretches that repeat with a period, found in an enhanced suffix array.

A run is a stretch with smallest period q of at least ``least`` words and ``times`` periods that no neighbouring word
extends. Whole texts are searched, one row at a time, and nothing shuffles:

1. A run of the wanted length shares all but its first period with itself, so each of its words lies in a gram of
   ``shared_words`` words that occurs twice in the text. Stretches without such grams cannot hold a run and are left out;
   the stretches are laid end to end, each behind a word of its own.
2. Suffixes are sorted by doubling; the names of each round also give the common prefixes of neighbours, longest power of
   two first.
3. Branching tandems: a square of period d that its next word breaks has both of its halves in one interval of common
   prefix d, in two different children. Intervals come off a stack in suffix order. For every suffix i in a child that is not
   the largest, the places of i + d and i - d in the suffix order tell whether they lie in the interval; no tree is built.
4. Each such square is rotated to the left as long as words d apart agree, which gives the whole run; runs of the same
   stretch that multiples of the period found again merge into the one with the smallest period.

Defined cases: a null text has no word and collapses to an empty one; texts without a run keep all words; equal rows give equal
results; a text is held by one task, with memory in proportion to its words in repeated grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import bounded_batches

MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    """Maximal stretches of other bytes than ASCII white space."""
    return (text or b"").split()


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def shared_words(least: int, times: int) -> int:
    """Words that a run of the wanted length shares with itself one period on, at least."""
    return min(least - least // times, (times - 1) * -(-least // times))


def in_repeated_grams(ids: np.ndarray, gram: int) -> np.ndarray:
    """Which words lie in a gram that occurs twice (by hash: an equal hash of other words only adds some)."""
    if len(ids) <= gram:
        return np.zeros(len(ids), bool)
    h, n, full = (ids.astype(np.uint64) + np.uint64(1)) * MIX, 1, None
    left = gram
    full_at = 0
    while True:
        if left & n:
            part = h[full_at:]
            full = part if full is None else full[: len(part)] * (MIX ^ np.uint64(n)) + part[: len(full)]
            full_at += n
            left &= ~n
        if not left:
            break
        h = h[:-n] * (MIX + np.uint64(2 * n)) + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    full = full[: len(ids) - gram + 1]
    order = np.argsort(full, kind="stable")
    same = full[order][1:] == full[order][:-1]
    twice = np.zeros(len(full), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + gram, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, place of each, words that each shares with the one before it in the order)."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    names, h = [rank.astype(np.int32)], 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h *= 2
        if rank[order[-1]] == n - 1:
            break
        names.append(rank.astype(np.int32))
    a, b = order[1:].copy(), order[:-1].copy()
    low = np.zeros(n, np.int64)
    for k in range(len(names) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[names[k][a[inside]] == names[k][b[inside]]]
        # the end of the text is no word: a name of 2 ** k words that runs over it is one suffix's alone
        low[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place, low


def intervals(low: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(common prefix, first, last, where children start) of all intervals of the suffix order with a common prefix."""
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [0])]
    for k in range(1, len(low) + 1):
        depth, first = low[k] if k < len(low) else -1, k - 1
        while stack and stack[-1][0] > depth:
            d, first, starts = stack.pop()
            if d > 0:
                yield d, first, k - 1, starts
        if k == len(low):
            return
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(k)
        else:
            stack.append((depth, first, [first, k]))


def branching_tandems(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares of words that the next word breaks."""
    order, place, low = suffix_order(ids)
    small, lows, highs, depths = [], [], [], []
    for d, first, last, starts in intervals(low.tolist()):
        ends = [*starts[1:], last + 1]
        sizes = [e - s for s, e in zip(starts, ends, strict=True)]
        largest = sizes.index(max(sizes))
        for c, (s, e) in enumerate(zip(starts, ends, strict=True)):
            if c != largest:
                small.append((s, e))
                lows.append(first)
                highs.append(last)
                depths.append(d)
    if not small:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spans = np.array(small)
    sizes = spans[:, 1] - spans[:, 0]
    which = np.repeat(np.arange(len(spans)), sizes)
    slot = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + spans[which, 0]
    i, d = order[slot], np.array(depths)[which]
    low_at, high_at = np.array(lows)[which], np.array(highs)[which]
    starts, periods = [], []
    for other in (i + d, i - d):
        ok = np.flatnonzero((other >= 0) & (other < len(ids)))
        at = place[other[ok]]
        child = spans[which[ok]]
        ok = ok[(at >= low_at[ok]) & (at <= high_at[ok]) & ((at < child[:, 0]) | (at >= child[:, 1]))]
        starts.append(np.minimum(i[ok], other[ok]))
        periods.append(d[ok])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    keep = in_repeated_grams(ids, shared_words(least, times))
    if not keep.any():
        return []
    at = np.flatnonzero(keep)
    first = np.append(True, at[1:] != at[:-1] + 1)
    # a word of its own before each stretch: no square reaches over it
    slot = np.arange(len(at)) + np.cumsum(first)
    text = np.empty(slot[-1] + 1, np.int64)
    text[slot] = ids[at]
    text[slot[first] - 1] = ids.max() + 1 + np.arange(first.sum())
    back = np.full(len(text), -1, np.int64)
    back[slot] = at
    start, period = branching_tandems(text)
    squares = np.unique(np.stack([period, start], 1), axis=0)
    ends: dict[int, list[tuple[int, int]]] = {}
    found = []
    for d, s in squares.tolist():
        end = s + 2 * d
        known = ends.setdefault(end, [])
        if any(d % q == 0 and begin <= s for q, begin in known):
            continue
        begin = rotated(text, s, d)
        known.append((d, begin))
        if end - begin >= max(least, times * d):
            found.append((int(back[begin]), end - begin, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def rotated(text: np.ndarray, s: int, d: int) -> int:
    """Where the words d apart that agree from s on begin to agree."""
    step = 1
    while s:
        k = min(step, s)
        differ = np.flatnonzero(text[s - k : s] != text[s - k + d : s + d])
        if len(differ):
            return s - k + int(differ[-1]) + 1
        s -= k
        step *= 4
    return 0


def kept_words(count: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run contains after its first period."""
    edge = np.zeros(count + 1, np.int64)
    for s, n, d in runs:
        edge[s + d] += 1
        edge[s + n] -= 1
    return np.cumsum(edge[:-1]) == 0


def find(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, runs (start, length, period; by start and period), collapsed (the kept words, joined by a space)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                own = runs_of(numbered(words), least, times)
                if own:
                    words = [w for w, k in zip(words, kept_words(len(words), own).tolist(), strict=True) if k]
                found.append([{"start": s, "length": n, "period": d} for s, n, d in own])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, FOUND), pa.array(texts, pa.binary())], names=["doc_id", "runs", "collapsed"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = own.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
