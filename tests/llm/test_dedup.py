"""Suffix-array, sentence-span and Jaccard dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from seqloom.llm import jaccard, marks, queries, sentences, suffixes
from seqloom.plans.lineage import materialize


def brute_suffixes(texts, window=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                covered[i : i + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.view(np.int8)])) == 1))
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mutated(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        t[rng.randrange(len(t))] = rng.choice("xyz ")
    return "".join(t)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoin", k=rng.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(8)]
    texts = base + [mutated(rng, b, k) for b in base for k in (0, 1, 3)]
    texts += [base[0][:450] + base[1][100:560] + base[2][:300], "é" * 700, "ab" * 600, "xy" + "ab" * 300, base[3][:399], base[3][:400]]
    return texts


@pytest.mark.parametrize("shard_bytes", [4_000_000, 3000])
def test_suffixes(make, copies, shard_bytes):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(make(copies), shard_bytes=shard_bytes).collect()}
    assert [got[i] for i in range(len(copies))] == brute_suffixes(copies)


def hot_line(n, length, seed=3):
    """Texts with one line in common, whose surroundings differ but for some that go on alike before or behind it."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    line, near, dashes = word(length), [word(150) for _ in range(3)], "-" * 90
    texts = []
    for i in range(n):
        left, right = word(rng.randint(0, 500)), word(rng.randint(0, 500))
        if i % 4 == 1:
            right = near[i % 3] + right
        if i % 7 == 2:
            left += near[i % 3]
        texts.append(left + (dashes if i % 5 == 3 else "") + line + right)
    return texts


@pytest.mark.parametrize("length", [70, 300, 399])
def test_suffixes_with_a_line_in_every_text(make, length):
    texts = hot_line(60, length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(make(texts), shard_bytes=2000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_suffixes(texts)


def test_a_line_in_every_text_is_narrowed_in_proportion(make, monkeypatch):
    volume = {}

    def counted(df, name="cut"):
        out = materialize(df, name)
        if name in ("narrower", "classes"):
            volume[name] = volume.get(name, 0) + (out.selectExpr("sum(length(piece))").first()[0] or 0)
        return out

    monkeypatch.setattr(suffixes, "materialize", counted)
    seen = []
    for n in (60, 240):
        volume.clear()
        suffixes.dedup(make(hot_line(n, 399)), shard_bytes=2000).count()
        seen.append(sum(volume.values()))
    assert 0 < seen[1] <= 4.8 * seen[0]


def test_suffixes_odd(odd, odd_texts, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(odd, keep=False).collect()}
    assert [got[i] for i in range(len(odd_texts))] == brute_suffixes(odd_texts)
    assert suffixes.dedup(none).count() == 0


def brute_passages(texts, window):
    own = [re.findall(r"[^ \t-\r]+", t or "") for t in texts]
    held = collections.Counter(g for w in own for g in {tuple(w[i : i + window]) for i in range(len(w) - window + 1)})
    out = []
    for w in own:
        covered = np.zeros(len(w) + 1, np.int8)
        for i in range(len(w) - window + 1):
            if held[tuple(w[i : i + window])] > 1:
                covered[i : i + window] = 1
        out.append((int(np.count_nonzero(np.diff(np.append(0, covered)) == 1)), int(covered.sum())))
    return out


def with_passages(n=24):
    """Texts of which some share a passage, once or often in a text, with another between, or only with themselves."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [some(k) for k in (51, 52, 50, 90)]
    texts = []
    for i in range(n):
        own = some(70)
        parts = [[], shared[i % 4], shared[i % 4] * 3, own * 2, shared[0] + shared[3], own + own[:49]][i % 6]
        texts.append(rng.choice([" ", "\n", " \t"]).join(some(rng.randint(0, 120)) + parts + some(rng.randint(0, 120))))
    return texts


@pytest.mark.parametrize("shard_bytes", [4_000_000, 700])
def test_passages(make, copies, odd_texts, shard_bytes):
    for texts in (with_passages(), copies, odd_texts):
        found = suffixes.dedup(make(texts), shard_bytes=shard_bytes if texts is not odd_texts else 100 * shard_bytes, keep=False, passage=51).collect()
        got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in found}
        assert [got[i] for i in range(len(texts))] == brute_passages(texts, 51)
        if texts is copies:
            got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
            assert [got[i] for i in range(len(texts))] == brute_suffixes(texts)


def test_passages_around_a_line_in_every_text(make, monkeypatch):
    tables = []
    monkeypatch.setattr(suffixes, "materialize", lambda df, name="cut": tables.append(name) or materialize(df, name))
    rng = random.Random(4)
    some = lambda k: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(k))
    line, near = some(30), [some(40) for _ in range(3)]
    texts = [" ".join([some(rng.randint(1, 60)), line, near[i % 3] if i % 4 == 1 else "", some(rng.randint(1, 60))]) for i in range(60)]
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in suffixes.dedup(make(texts), shard_bytes=600, passage=51).collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 51)
    assert 5 < sum(n > 0 for n, _ in got.values()) < 30
    assert "narrower" in tables


def test_short_planted_passages_are_caught_by_the_query(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 6))) for _ in range(3000)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    planted = [some(51 + i % 10) for i in range(10)]
    texts = [" ".join(some(80) + (planted[i // 2] if i < 20 else []) + some(80)) for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op1_suffixes(spark, str(tmp_path)).collect()}
    assert {i for i, r in rows.items() if r.n_passages} == set(range(20))
    assert all(rows[i].n_passage_words == 51 + i // 2 for i in range(20))
    assert [tuple(rows[i])[1:5] for i in range(60)] == brute_suffixes(texts)


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    text = np.array([rng.choice([1, 2, 3]) for _ in range(500)] * 2, np.uint8)
    words = suffixes.packed(text)
    order, place = suffixes.suffix_array(words)
    data = text.tobytes()
    assert [data[i:] for i in order] == sorted(data[i:] for i in range(len(data)))
    low = suffixes.common_prefixes(words, order, place, 40, lane=37)
    for k in range(1, len(order)):
        a, b = data[order[k] :], data[order[k - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert low[order[k]] == min(40, n)


def brute_sentences(texts):
    seen = {}
    own = []
    for i, t in enumerate(texts):
        s = list(sentences.spans(t))
        own.append(s)
        for a, _b, *h in s:
            seen.setdefault(tuple(h), (i, a))
    out = {}
    for i, s in enumerate(own):
        gone = {k for a, b, *h in s if seen[tuple(h)] != (i, a) for k in range(a, b)}
        if gone:
            out[i] = "".join(x for k, x in enumerate(sentences.split(texts[i])) if k not in gone)
    return out


def test_sentences(make, none, odd, odd_texts):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("aeiourst", k=5)) for _ in range(rng.randint(3, 12))) + rng.choice([". ", "!\n", "? "])
    passage = "".join(line() for _ in range(8))
    texts = ["".join(line() for _ in range(6)) + (passage if k % 2 else "") + "".join(line() for _ in range(4)) for k in range(8)] + [passage, passage.upper(), "", None, "Of. The."]
    for data, frame in ((texts, make(texts)), (odd_texts, odd)):
        got = {r.doc_id: r.kept for r in sentences.dedup(frame).collect()}
        assert got == brute_sentences(data)
    assert {1, 3, 5, 7} - set(brute_sentences(texts)) == {1}
    assert sentences.dedup(none).count() == 0


def all_runs(texts):
    """Kept text by every run of 2 sentences and 16 words or more, all of them enumerated; for texts of plain sentences."""
    own = [re.findall(r"[^.!?\n]+[.!?\n]+ ?", t) for t in texts]
    seen, places = {}, []
    for d, s in enumerate(own):
        for i in range(len(s)):
            for j in range(i + 2, len(s) + 1):
                run = tuple(tuple(x.lower().split()) for x in s[i:j])
                if sum(map(len, run)) >= 16:
                    places.append((d, i, j, run))
                    seen.setdefault(run, (d, i))
    gone = {(d, k) for d, i, j, run in places if seen[run] != (d, i) for k in range(i, j)}
    return {d: "".join(x for k, x in enumerate(s) if (d, k) not in gone) for d, s in enumerate(own) if any((d, k) in gone for k in range(len(s)))}


def test_sentences_against_all_runs(make):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choices("aeiourst", k=5)) for _ in range(n)) + rng.choice([". ", "!\n", "? "])
    fresh = lambda n: "".join(line(rng.randint(2, 11)) for _ in range(n))
    passages = [fresh(rng.randint(2, 7)) for _ in range(6)] + [line(14) + line(3) + line(4), line(3) + line(15)]
    texts = [fresh(rng.randint(0, 4)) + rng.choice(passages) + fresh(rng.randint(1, 4)) + rng.choice(["", *passages]) + fresh(1) for _ in range(60)]
    want = all_runs(texts)
    assert len(want) > 20 and {r.doc_id: r.kept for r in sentences.dedup(make(texts)).collect()} == want


def test_sentences_of_other_scripts(make):
    han, hindi, thai = "今天天气很好我们一起去公园里散步。孩子们在绿色的草地上玩得非常开心！", "यह एक लंबा वाक्य है जो दो बार आता है। यह दूसरा वाक्य भी दोनों पाठों में है। ", "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะ\nเด็กเด็กเล่นกันอย่างสนุกสนานมากบนสนามหญ้า\n"
    texts = [x + y for x in (han, hindi, thai) for y in ("", "end")] + ["很好。", "很好。"]
    assert {r.doc_id: r.kept for r in sentences.dedup(make(texts)).collect()} == {1: "end", 3: "end", 5: "end"}


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    name = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both) and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = {x: new if c == old else c for x, c in name.items()}
    return {i: (len(s), name[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_jaccard(make, odd_texts, k, num):
    rng = random.Random(k)
    words = ["".join(rng.choices("etaoinsh", k=rng.randint(1, 5))) for _ in range(300)]
    texts = list(odd_texts) + ["a b c", "A B C", "a b"]
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _copy in range(25):
            t = list(base)
            for _e in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    want = brute_components(texts, k, num, 100)
    for options in ({}, {"centre_rounds": 3, "spread": 0}) if k == 5 else ({},):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(make(texts), k, num, 100, **options).collect()}
        assert got == want
    kept = jaccard.keep_one(make(texts), k=k, num=num)
    assert kept.columns == make(texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_jaccard_without_ids_and_rows(spark, none):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, "a b c d e"), (6, None)]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("3", 3), ("3", 3), ("5", 3), ("6", 6), ("None", None)]
    assert jaccard.link(none).count() == 0


def test_jaccard_of_shared_ids(spark):
    """Rows that share a doc_id but not the text are documents of their own; repeated rows are one."""
    one, two, three = ("x y z u v w " * 3 + "one", "k l m n o p q r s t", "a b c d e f g h i j")
    rows = [(1, one), (1, two), (2, two), (2, two), (2, three), (3, three), (None, three), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, 9, "q") for i, t in rows], "doc_id int, text string, th int, `own.gone` string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.link(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (3, 2), (4, 4), (4, 4)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, three), (1, two), (1, one), (2, three), (4, "")]


def test_bitmap_grows_with_the_wanted_rows(spark, monkeypatch):
    rows = spark.range(0, 60_000, 1, 5).selectExpr("id", "cast(id % 7 as string) as word")
    few, many = rows.where("id % 100 = 0").cache(), rows.where("id % 2 = 0").cache()
    monkeypatch.setattr(marks, "LEAST", 16)
    for wanted, size in ((few, 1 << 16), (many, 1 << 18), (rows.where("id < 0"), 1 << 16)):
        assert marks.Bitmap(wanted, "id", "word").size == size
        ids = {r.id for r in wanted.collect()}
        got = {r.id for r in rows.where(marks.maybe_in(wanted, "id", "word")).collect()}
        assert ids <= got and len(got - ids) <= 0.15 * 60_000 * bool(ids)
    monkeypatch.setattr(marks, "MOST", 16)
    assert {r.id for r in many.collect()} <= {r.id for r in rows.where(marks.maybe_in(many, "id", "word")).collect()}
