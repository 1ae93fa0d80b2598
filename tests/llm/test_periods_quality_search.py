"""Periodic runs, quality scores and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from seqloom.llm import lexical, periods, quality
from seqloom.llm import queries as q


def plain_runs(words, least, times):
    """Maximal stretches by comparing words q apart, for every q; the smallest period of equal stretches counts."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j > i and j + period - i >= max(least, times * period):
                found.setdefault((i, j + period - i), period)
            i = max(j, i) + 1
    return sorted(((s, n, d) for (s, n), d in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, letters):
    out = []
    for _ in range(rng.randint(1, 6)):
        if rng.random() < 0.5:
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            out += (unit * 20)[: rng.randint(1, 60)]
        else:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 30))]
    return [b"w%d" % x for x in out]


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (4, 2), (5, 2), (7, 4), (2, 2)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(150):
        words = periodic_words(rng, rng.choice([1, 2, 3, 5, 50]))
        assert periods.runs_of(periods.numbered(words), least, times) == plain_runs(words, least, times)


def test_runs_of_one_word_and_long_periods():
    assert periods.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    x = np.arange(30_000) % 9_001
    assert periods.runs_of(x) == [(0, 30_000, 9_001)]
    assert periods.runs_of(np.arange(1000)) == [] == periods.runs_of(np.zeros(23, np.int64))


def plain_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 24, 3)
    drop = {i for s, length, d in runs for i in range(s + d, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{d}\n" for s, m, d in runs), " ".join(w for i, w in enumerate(words) if i not in drop))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *sha)


def test_op11_against_plain(spark, sf, tmp_path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [(i, t) for i, t in docs if len(t) < 4000] + [(10_000 + k, t) for k in range(60) for t in ["a b c " * 30, " x\t\x0by " + "same " * 30 + "\x85end"][k % 2 : k % 2 + 1]] + [(20_000, None), (20_001, ""), (20_002, " \n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in q.op11_periods(spark, str(tmp_path)).collect()}
    assert got == {i: plain_op11(i, t) for i, t in docs}
    assert sum(r[1] > 0 for r in got.values()) > 60


def test_periods_of_odd_rows(odd, none):
    rows = periods.find(odd).collect()
    assert [r.runs for r in rows if r.doc_id == 5] == [[(0, 900, 1)]] and next(r.collapsed for r in rows if r.doc_id == 5) == "ab"
    assert [r.collapsed for r in rows if r.doc_id in (0, 1, 2)] == ["", "", ""]
    assert periods.find(none).collect() == []


def test_tokens_and_index_sums():
    texts = [b"ab, ab cd!!", None, "été 12".encode(), b"", b"ab"]
    h, doc = quality.tokens(texts)
    assert doc.tolist() == [0, 0, 0, 0, 0, 2, 2, 4]
    assert h[0] == h[2] == h[7] and len(set(h.tolist())) == 6
    one, two = (np.zeros(quality.WORDS * quality.DIMS, np.int64) for _ in range(2))
    quality.add_contexts(one, texts)
    for t in reversed(texts):
        quality.add_contexts(two, [t])
    assert (one == two).all()
    plain = np.zeros((quality.WORDS, quality.DIMS), np.int64)
    for d in set(doc.tolist()):
        own = [int(x) for x, e in zip(h, doc, strict=True) if e == d]
        for i, x in enumerate(own):
            for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                for k in range(2) if i != j else ():
                    bits = own[j] >> (24 + 8 * k)
                    plain[x % quality.WORDS, bits % quality.DIMS] += 1 - 2 * (bits // quality.DIMS % 2)
    assert (one.reshape(plain.shape) == plain).all()


def test_network_gradients():
    rng = np.random.default_rng(0)
    net, x, y = quality.Network(4, 3), rng.normal(size=(7, 4)), np.array([1, 0, 1, 1, 0, 0, 1.0])

    def loss():
        z = np.tanh(x @ net.w[0] + net.w[1]) @ net.w[2] + net.w[3][0]
        return np.mean(np.log1p(np.exp(z)) - y * z) + 0.05 * ((net.w[0] ** 2).sum() + (net.w[2] ** 2).sum())

    for part, grad in zip(net.w, net.gradients(x, y, 0.1), strict=True):
        for at in np.ndindex(part.shape):
            was, part[at] = part[at], part[at] + 1e-6
            up = loss()
            part[at] = was - 1e-6
            down = loss()
            part[at] = was
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


def test_quality_of_held_out_documents(spark, tmp_path):
    """Learns from the other documents, is near the labels, calibrated, and blind to doc_id and lang."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op12_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in rows.values() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.7) for r in rows.values())
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert abs(sum(r.score for r in held) / len(held) - sum(labels[r.doc_id] for r in held) / len(held)) < 0.06
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_text = {}
    for i, r in rows.items():
        by_text.setdefault(texts[i], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, 1, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, score int")
    got = quality.assess(odd, labels).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.assess(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.assess(none, labels).collect() == []


def plain_search(docs, items, best):
    """All scores by the contract's words, in exact integers."""

    def terms(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    cut = [(i, terms(t)) for i, t in docs]
    number, total = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    df = {}
    for _, w in cut:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in cut:
            m = 25 + 75 * len(w) * number // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if w.count(t))
            if s > 0:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:best])]
    return sorted(out)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_search_against_plain(spark, bucket):
    rng = random.Random(bucket)
    words = [f"w{k}" for k in range(60)] + ["Grün", "GRÜN", "x1", "日本"]
    weight = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=rng.choice([0, 1, 5, 30, 200]))) + rng.choice(["", ".", " W3-w4_w5"]) for _ in range(120)]
    texts += texts[:20] + [None, "", "...", "only here"]
    docs = list(enumerate(texts))
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(15)] + [(50, None), (51, ""), (52, "unknown"), (53, "W0 w0 w0 Only HERE"), (54, texts[5])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items + items[:2], "item_id long, text string")
    for best in (10, 1, 500):
        assert sorted(tuple(r) for r in lexical.search(d, i, best, bucket=bucket).collect()) == plain_search(docs, items, best)
    assert sorted(tuple(r) for r in lexical.search(d, i, block_chars=100).collect()) == plain_search(docs, items, 10)


def test_search_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert sorted(tuple(r) for r in q.op13_lexical(spark, sf).collect()) == sorted(con.execute(q.ORACLES["op13_lexical"]).fetchall())


def test_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "ein WORT", 5), (None, "same text", 5)], "item_id long, text string, doc_id int")
    rows = sorted(lexical.search(odd, items).collect(), key=str)
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [(1, 1, 4), (None, 1, 8), (None, 2, 9)]
    assert lexical.search(none, items).collect() == [] == lexical.search(odd, items.limit(0)).collect()


def test_buckets_are_pruned():
    """A bucket whose longest vector cannot reach the threshold is not looked into."""
    bucket = lexical.Bucket([1, 2], [np.array([0], np.int32).tobytes()] * 2, [np.array([5], np.int64).tobytes()] * 2, np.array([5.0, 5.0]))
    query = lexical.Query({0: 3}, 16, 1)
    bucket.column = None
    query.search(bucket)
    assert query.found == []
