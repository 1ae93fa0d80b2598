"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by ``rate`` * m edits. Cut into one piece more than that, at least one piece of
any match is unharmed, so exact hits of pieces (one Aho-Corasick automaton for all) give every place worth checking;
each is verified with Myers' bit-parallel edit distance. Texts and items are compared lower-cased with every run of
other characters than letters and digits as one space.

The items are the broadcast side and go in blocks of at most about ``block_chars`` characters, each block against all
documents; the documents never shuffle.

Defined cases: null or empty texts match nothing; null or empty items are ignored; items of under ``short`` characters
match only exactly and as whole words; repeated items and rows each give their rows. Offsets are in the compared form.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import bounded_batches

ROWS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
OTHER = re.compile(r"[\W_]+")


def compared(text: str | None) -> str:
    return f" {OTHER.sub(' ', (text or '').lower()).strip()} "


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, end of the first such)."""
    m = len(pattern)
    every, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    up, down, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (every & ~(d0 | up)), up & d0
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & every, (left << 1) & every
        up, down = left | (every & ~(d0 | right)), right & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    cuts = [k * len(item) // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """All pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, short: int) -> None:
        self.items: list[tuple[int, str, int]] = []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            pattern = compared(text)
            if not pattern.strip():
                continue
            inner = pattern[1:-1]
            budget = int(rate * len(inner)) if len(inner) >= short else 0
            pattern = inner if budget else pattern
            for offset, piece in pieces(pattern, budget):
                where[piece].append((len(self.items), offset))
            self.items.append((item_id, pattern, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item within its budget."""
        if not self.items or not text:
            return []
        own, spans = compared(text), defaultdict(list)
        for end, (size, places) in self.automaton.iter(own):
            for k, offset in places:
                spans[k].append(end + 1 - size - offset)
        out = []
        for k, starts in spans.items():
            item_id, pattern, budget = self.items[k]
            best = None
            for a, b in windows(sorted(starts), len(pattern), budget, len(own)):
                distance, end = myers(pattern, own[a:b])
                if distance <= budget and (best is None or distance < best[1]):
                    back = myers(pattern[::-1], own[a : a + end][::-1])[1]
                    best = (item_id, distance, a + end - back, a + end)
            if best:
                out.append(best)
        return sorted(out)


def windows(starts: list[int], size: int, budget: int, limit: int) -> Iterator[tuple[int, int]]:
    """Merged stretches of text in which a match that begins near one of the starts lies."""
    a = b = None
    for s in starts:
        lo, hi = max(0, s - budget), min(limit, s + size + budget)
        if b is not None and lo <= b:
            b = max(b, hi)
        else:
            if b is not None:
                yield a, b
            a, b = lo, hi
    if b is not None:
        yield a, b


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[Broadcast]:
    """The items in broadcast blocks of about ``block_chars`` characters, dealt by a hash of their text."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.05, short: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, end): documents that hold a test item, one row for each item held."""
    schema = "doc_id long, item_id long, distance int, start int, end int"
    out = None
    for own in item_blocks(items, block_chars):

        def find(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own.value, rate, short)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in matcher.matches(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r, strict=True)) for r in rows], schema=ROWS)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.05, short: int = 40, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no test item. Same columns; nothing shuffles."""
    bounded_batches(docs.sparkSession)
    for own in item_blocks(items, block_chars):
        docs = docs.where(~holds(own, rate, short)(F.col("text").cast("string")))
    return docs


def holds(own: Broadcast, rate: float, short: int):
    """Whether a text holds one of the items."""

    @F.pandas_udf("boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(own.value, rate, short)
        for texts in batches:
            yield pd.Series([bool(matcher.matches(t)) for t in texts], dtype=bool)

    return of
