"""Mixing, sharding, the pipeline, and what remains without the subpackage."""

import itertools
import random
import re
import shutil
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import mixing, sharding
from seqloom.llm import queries as q


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2) == []


def test_flow_is_cheapest():
    """Against trying everything on a small network with an overlapping pattern."""
    supply, members, quota = [3, 2, 2], [[0], [1], [0, 1]], [4, 3]
    flow = mixing.min_cost_flow(supply, members, quota, 2)
    cost = lambda f: sum(max(0, sum(x) - s) for x, s in zip(f, supply))
    assert [sum(flow[0]) + flow[2][0], sum(flow[1]) + flow[2][1]] == quota
    best = min(max(0, a - 3) + max(0, b - 2) + max(0, c + d - 2) for a, b, c, d in itertools.product(range(7), range(5), range(5), range(5)) if a + c == 4 and b + d == 3 and c + d <= 4)
    assert cost(flow) == best


def test_mix(odd, odd_texts, none, spark, sf):
    for df, texts in ((odd, odd_texts), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        got = mixing.mix_by_source(df).toPandas()
        texts = texts or [r.text for r in df.orderBy("doc_id").collect()]
        size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
        assert dict(zip(got.doc_id, got["size"])) == size
        assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
        name = got.members.map(lambda m: m[0])
        names = sorted(set(name), key=lambda x: (x is None, x or ""))
        sums = [int(got["size"][[n == x for n in name]].sum()) for x in names]
        want = mixing.targets(sums, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)
        for x, total, goal in zip(names, sums, want):
            own = got[[n == x for n in name]]
            assert own.source_size.eq(total).all() and own.target.tolist() == pytest.approx([goal] * len(own)) and abs(int(own.taken.sum()) - goal) <= 1
        again = mixing.mix_by_source(df).toPandas()
        assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))
    assert mixing.mix_by_source(none).count() == 0


def test_flow_on_small_networks():
    """Random overlapping patterns against every allocation."""
    rng = random.Random(6)
    for _ in range(60):
        n = rng.choice([2, 3])
        members = rng.sample([list(c) for k in (1, 2) for c in itertools.combinations(range(n), k)], 3)
        supply = [rng.randint(0, 3) for _ in members]
        shares = [[y for y in itertools.product(range(2 * s + 1), repeat=len(m)) if sum(y) <= 2 * s] for s, m in zip(supply, members)]
        into = lambda f: [sum(x for own, m in zip(f, members) for x, to in zip(own, m) if to == k) for k in range(n)]  # noqa: B023, E731
        cost = lambda f: sum(max(0, sum(x) - s) for x, s in zip(f, supply))  # noqa: B023, E731
        quota = into([rng.choice(x) for x in shares])
        flow = mixing.min_cost_flow(supply, members, quota, 2)
        assert all(sum(x) <= 2 * s for x, s in zip(flow, supply))
        assert into(flow) == quota
        assert cost(flow) == min(cost(f) for f in itertools.product(*shares) if into(f) == quota)


def test_overlapping_sources(spark):
    """Two sources with common documents: quotas met to the word with the fewest repeats that any split of the common words allows."""
    rows = [(i, "w " * (1 + i % 6), ["a"] if i % 7 < 3 else ["b"] if i % 7 < 6 else ["a", "b"]) for i in range(84)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, members array<string>"), cycle=(3, 1)).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and dict(zip(got.doc_id, got["size"])) == {i: 1 + i % 6 for i, *_ in rows}
    kinds = got.groupby(got.members.map(tuple))[["size", "taken"]].sum()
    a, b, both = (int(kinds["size"][k]) for k in (("a",), ("b",), ("a", "b")))
    goals = [1.5 * (a + b + 2 * both) * w / 4 for w in (3, 1)]
    if goals[0] > 2 * (a + both):
        goals = [2 * (a + both), sum(goals) - 2 * (a + both)]
    assert got.target[got.members.map(lambda m: m[0] == "a")].iloc[0] == pytest.approx(goals[0]) and goals[1] <= 2 * (b + both)
    qa, qb = (round(x) for x in goals)
    costs = [max(0, qa - x - a) + max(0, qb - y - b) + max(0, x + y - both) for x in range(2 * both + 1) for y in range(2 * both + 1 - x) if 0 <= qa - x <= 2 * a and 0 <= qb - y <= 2 * b]
    assert int(got.taken.sum()) == qa + qb and int((kinds.taken - kinds["size"]).clip(lower=0).sum()) == min(costs)


def test_more_patterns_than_the_driver_holds(spark):
    """As tables: one source a document for 5,000 of them, and the same plan as from the driver, overlaps included."""
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"host{i // 2}") for i in range(10_000)], "doc_id long, text string, source string")
    got = mixing.mix_by_source(many).toPandas()
    own = got.assign(name=got.members.map(lambda m: m[0])).groupby("name").agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first")).sort_index()
    want = mixing.targets(own["size"].tolist(), [(5, 2, 1)[k % 3] for k in range(len(own))], 1.5, 2)
    assert len(got) == 10_000 and own.target.tolist() == pytest.approx(want) and own.taken.tolist() == [round(x) for x in own.target]
    kinds = [["a"], ["b"], ["a", "b"], ["c"], [None], ["d", "e"], ["e"], ["f"]]
    df = spark.createDataFrame([(i, "w " * (i % 9), kinds[i % 8]) for i in range(400)], "doc_id long, text string, members array<string>")
    a, b = (mixing.mix(df, max_patterns=n).toPandas().sort_values("doc_id", ignore_index=True) for n in (4096, 3))
    assert a.target.tolist() == pytest.approx(b.target.tolist()) and a["source_size"].tolist() == b["source_size"].tolist()
    alone = ~a.members.map(lambda m: "a" in m or "b" in m or "d" in m or "e" in m)
    assert a.taken[alone].tolist() == b.taken[alone].tolist() and a.taken.sum() == b.taken.sum() and (b.taken <= 2 * b["size"]).all()


def test_shards(odd, odd_texts, none, spark, sf):
    for df, texts in ((odd, odd_texts), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        got = sharding.shard(df).toPandas()
        texts = texts or [r.text for r in df.orderBy("doc_id").collect()]
        for i, size, crc in zip(got.doc_id, got["size"], got.text_crc32):
            data = (texts[i] or "").encode()
            assert size == len(data) + 1 and crc == zlib.crc32(data)
        for _, own in got.groupby("shard"):
            assert sorted(own.slot) == list(range(len(own)))
        sums = got.groupby("shard")["size"].sum()
        assert len(got) == len(texts) and sums.max() - sums.min() <= 2 * got["size"].max()
    assert sharding.shard(none).count() == 0


def test_shards_of_one_hot_text(spark):
    df = spark.createDataFrame([(i if i % 7 else None, "same") for i in range(700)], "doc_id long, text string")
    got = sharding.shard(df, ranges=16).toPandas()
    assert got.groupby("shard").size().tolist() == [88, 87, 88, 87, 88, 87, 88, 87] or got.groupby("shard").size().between(86, 89).all()


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept.select("doc_id").collect()} and ids
        kept = spark.createDataFrame(out.collect(), out.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert final.count() == kept.count() and {"shard", "slot", "text"} <= set(final.columns)
    assert "pipeline" not in q.QUERIES and len(q.QUERIES) == 13


def test_pipeline_leaves_no_tables_of_its_stages(spark, sf):
    from seqloom.plans.lineage import shared_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    names = lambda: {x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    before = names()
    rows = corpus_pipeline.run(spark, sf).count()
    left = {n.rsplit("-", 1)[0] for n in names() - before}
    assert rows and left == {"pipeline-mix", "shard-keys", "shard-starts"}  # what the lazy result reads


def test_applied_mix_takes_whole_documents_as_the_mix_does(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: round(r.taken / max(1, r["size"])) for r in mixing.mix_by_source(docs).collect()}
    got = {r.doc_id: r.n for r in mixing.apply_mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}
    size = {r.doc_id: len(re.findall("[^\\x20\\x09-\\x0D]+", r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    goal = {source[r.doc_id]: r.target for r in mixing.mix_by_source(docs).collect()}
    for s, words in goal.items():
        largest = max(n for i, n in size.items() if source[i] == s)
        assert abs(sum(n * size[i] for i, n in got.items() if source[i] == s) - words) <= largest


NAMES = (
    "lang_pred score own found size source_size target taken times key tie text_crc32 shard slot law range_id grown_shard carried place middle nth upto th doc row node n component "
    "pattern members pick gone first rows cell c1 c2 spans redacted n_email base_sha256 bit more full rest _th _doc _id _t _copy"
).split()


def test_pipeline_odd_and_clashing(spark, sf, odd_texts):
    """Odd texts, repeated and id-less rows, and extra columns with every name that stages use inside."""
    texts = [*odd_texts, *(f"the {w} of a house by the river is {w} and old" for w in ("red", "blue", "green", "grey", "small", "large", "cold", "warm"))]
    rows = [(None if i == 3 else i, t, "en", "s" if i % 3 else None, None, *[7] * len(NAMES)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES)
    for data in (rows + rows[-3:], []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            got = out.collect()
            assert len(set(out.columns)) == len(out.columns), name
            if name != "shards":
                assert out.columns == docs.columns and all(r["score"] == r["_th"] == r["own"] == 7 for r in got), name
                docs = spark.createDataFrame(got, out.schema)
        assert len(got) == docs.count() and {"shard", "slot", "carried_shard", "carried_slot", "score", "text"} <= set(out.columns)
        assert all(r["carried_size"] == r["key"] == 7 for r in got) and bool(got) == bool(data)


def test_operators_take_clashing_columns(spark, sf, odd_texts):
    from seqloom.llm import html_text, langid, media, pii

    docs = spark.createDataFrame([(i, t, *[7] * len(NAMES)) for i, t in enumerate(odd_texts)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    for out in (langid.predict(docs, None), pii.find(docs), html_text.extract(docs, "text", "main"), media.sequences(docs, "text")):
        assert len(set(out.columns)) == len(out.columns) and out.count() == len(odd_texts)


def test_rest_works_without_the_subpackage(tmp_path):
    import os

    root = os.path.dirname(corpus_pipeline.__file__)
    shutil.copytree(f"{root}/seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); print('ok')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip().endswith("ok"), out.stderr
