"""HTML, personal data, language, media, decontamination."""

import hashlib
import html
import io
import math
import re
import wave
import zlib

import numpy as np
import pytest

from seqloom.llm import boosting, decontaminate, html_text, langid, media, pii
from seqloom.llm import queries as q

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head><body>
<div id="cookie-notice">We use cookies on this site, please accept all of them now.</div><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header>Site name</header><aside>Side <p>bar text that is long enough to be kept if it were counted as text</p></aside>
<article><h1>Big &amp; small</h1><p>First <b>para</b>graph&nbsp;here,
 with  space.<br>Next<p>Short.<!-- no --><div class="ad">Buy this now</div><form><input value=x>Mail me</form><p>Last &lt;one&gt; &eacute;.</article>
<section class="comments"><p>I like this article very much, thanks for writing it down for us all.</p></section><footer>&copy; me</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "Big & small First paragraph here, with space. Next Short. Last <one> é."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a < b</p>", "a < b"), ("<article><p>x<!-- open", "x"), ("<div class=sidebar>no</div>", ""), ("<p>" + "word " * 50 + "</p><ul class='menu'><li><a href=x>go</a></ul>", ("word " * 50).strip()), ('<p title="open>text', "text"), ("<article>" + "<p>w" * 2000, " ".join(["w"] * 2000))])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "This is the main text of the page, which goes on for quite a while so that it has some weight."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div id=page-with-header><header>Site</header><p>{LONG}</p><div class=sidebar>short side</div></div>", LONG),
        (f"<div class='layout sidebar-right'><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>short side</div>", f"{LONG} {LONG}"),
        (f"<form action=x><p>{LONG}</p><select><option>a</option></select></form>", LONG),
        ("<form><div>menu</div><article><p>Short.</p></article><div>other</div></form>", "Short."),
        (f"<article><p>{LONG}</p></article><section><article class='comment-body'><p>{LONG} I think so.</p></article></section>", LONG),
        (f"<article class='post comments-open'><p>{LONG}</p></article><div class=comments><article><p>{LONG} Me too.</p></article></div>", LONG),
        (f"<main><p>{LONG}</p></main><div class=sidebar><div class=related><article>{LONG} More.</article></div></div>", LONG),
        (f"<p>{LONG}</p><div class=comments><p>{LONG} One.</p><p>{LONG} Two.</p><p>{LONG} Three.</p></div>", LONG),
        (f"<article><p>{LONG}</p><form><p>Mail me</p></form></article>", LONG),
    ],
)
def test_wrappers_and_asides(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def test_given_pages_by_expressions(spark, sf):
    """Every given page has one plain article, which expressions can take out."""
    rows = q.op2_html(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        (own,) = re.findall(r"<article>(.*?)</article>", r.html, re.S)
        own = re.sub(r'<!--.*?-->|<div class="ad">.*?</div>|<(script|style)>.*?</\1>', " ", own, flags=re.S)
        own = re.sub(r"</?(?:p|h[1-6]|br|div|ul|ol|li|table|tr|td|th|blockquote|pre)\b[^>]*>", " ", own)
        want = " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", own)).split())
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() > 0


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 3), (2, "v", None, 4)], "page_id long, url string, html string, size int")
    out = {r.page_id: (r.n_chars, r["size"]) for r in html_text.extract(df).collect()}
    assert out == {1: (len(html_text.main_text(PAGE)), 3), 2: (0, 4)}


def base_spans(text):
    """The contract's expressions, run as they stand."""
    luhn = lambda d: sum(v - 9 * (v > 9) for k, x in enumerate(reversed(d)) for v in [int(x) * (1 + k % 2)]) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def test_rules_match_the_expressions():
    rng = np.random.default_rng(4)
    parts = ["a.b@c.de", "@x.y", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+12", " ", ".", "-", "+", "9", "é", "a@b.c@d.e", "00012.1.1.1", "%%@a-b.c", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert pii.rule_spans(text) == base_spans(text), text
    assert pii.rule_spans("1" * 100_000 + "a" * 100_000) == []


def test_pii_query(spark, odd, none):
    got = {r.doc_id: r for r in pii.find_in_documents(odd).collect()}
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    assert pii.find_in_documents(none).count() == 0
    texts = ["mail a.b@c.de or +1 (555) 555-1234", "é 10.0.0.1"]
    out = pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert out[0].spans == "email:5:13,phone:17:34" and out[0].redacted == "mail [email] or [phone]"
    assert out[1].spans == "ip:2:10" and out[1].base_sha256 == hashlib.sha256(b"ip:2:10").hexdigest()


def test_trees_add_what_the_rules_miss(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(words, 12))
    card = lambda: next(d for d in iter(lambda: "4" + "".join(map(str, rng.integers(0, 10, 15))), "") if pii.luhn(d))
    strict = [lambda: f"{rng.choice(words)}.{rng.integers(100)}@mail{rng.integers(9)}.example.com", lambda: ".".join(map(str, rng.integers(1, 255, 4))), card, lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"]
    model = pii.train(spark.createDataFrame([(f"{line()} {strict[k % 4]()} {line()}",) for k in range(1200)], "text string"))
    dotted = card()
    found = ["jo.doe (at) host (dot) org", "ann[at]site.net", "(415) 555-0199", "415.555.0199", "001 415 555 0199", ".".join(dotted[k : k + 4] for k in range(0, 16, 4))]
    clean = ["12 345 678", "1.234.567.890", "8675309123", "2024-01-15 10:30", "1998-2004", "3,14,15,92", "3.14 2.71 1.41 1.73", "1 2 3 4 5 6 7 8 9", "4111.1111.1111.1112", "a @ 10.30"]
    texts = [f"{line()} {x} {line()}" for x in found + clean]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), model=model).orderBy("id").collect()
    kinds = ["email", "email", "phone", "phone", "phone", "card"]
    want = [f"{k}:{(at := t.index(x))}:{at + len(x)}" for k, t, x in zip(kinds, texts, found)] + [""] * len(clean)
    assert [r.spans for r in got] == want
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)


def test_trees_learn_from_every_document(spark, monkeypatch):
    texts = [f"{'abcdefg'[k % 7]}{k} card 4111 1111 1111 1112 and +49 30 1234 {5000 + k % 5000}"[k % 3 :] for k in range(4600)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    seen = []
    monkeypatch.setattr(pii.boosting, "platt", lambda m, y, times: seen.append((int(times[y > 0].sum()), int(times[y == 0].sum()))) or (1.0, 0.0))
    pii.train(df, local=10**9)
    held = [y for t in texts if int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 == 4 for _, y in pii.labelled(t)]
    assert seen == [(sum(held), len(held) - sum(held))]


def test_trees_are_the_same_from_tasks_and_from_the_driver(spark):
    texts = [f"{'xyz'[k % 3]} tel {k % 90 + 10} 555 {1000 + k} or +1 (415) 555-{1000 + k} at 10.0.{k % 256}.{k % 200}, 4111 1111 1111 1112" for k in range(150)]
    a, b = (pii.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(n), local) for n, local in ((3, 10**9), (5, 0)))
    assert all(np.array_equal(getattr(a[0], c), getattr(b[0], c)) for c in ("features", "cuts", "leaves"))
    assert (a[0].slope, a[0].shift, a[1]) == (b[0].slope, b[0].shift, b[1]) and np.isfinite(a[0].cuts).any()


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    trees = boosting.fit(x, y)
    p = trees.probability(rng_x := rng.normal(size=(500, 5)))
    truth = (rng_x[:, 0] > 0.3) ^ (rng_x[:, 1] > 0)
    assert ((p > 0.5) == truth).mean() > 0.93
    assert boosting.threshold(np.array([0.9, 0.8, 0.2]), np.array([1, 1, 0]), 1.0) == 0.8


def test_language_held_out(spark, sf, odd, none):
    out = q.op7_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    crc = {r.doc_id: r.held_out for r in q.op7_langid(spark, sf).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in crc.items())
    got = {r.doc_id: r.lang_pred for r in langid.identify(odd).collect()}
    assert [got[i] for i in (0, 1, 2, 11)] == ["und"] * 4 and got[3] == "en"
    assert langid.identify(none).count() == 0


def as_wave(payload):
    """A mono file of 8-bit samples by the standard library's writer."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", "not compressed"))
            w.writeframes(payload)
        return out.getvalue()


def test_media_round_trip(make, odd_texts, none):
    texts = [*odd_texts, "one\ntwo & <b>three</b>\n\nfour &amp; five\n", "\n", "a\nb"]
    got = {r.doc_id: r for r in media.documents_as_media(make(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r, stored = got[i], as_wave(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.unpack(stored) == payload and wave.open(io.BytesIO(media.pack(payload))).readframes(len(payload)) == payload
        lines = [" ".join(x.split()) for x in (t or "").split("\n")]
        assert r.texts_sha256 == hashlib.sha256("\n".join(x for x in lines if x).encode()).hexdigest()
        assert (r.pos, r.n_items, r.caption) == (sum(map(bool, lines[: len(lines) // 2])), sum(map(bool, lines)) + 1, f"{len(t or '')} characters")
    assert got[0].feature == got[1].feature
    assert media.documents_as_media(none).count() == 0


def test_sequences(spark):
    page = '<p>One</p><figure><img src="media:ab"><figcaption>Cap <b>tion</b></figcaption></figure><p>Two<img src="x.png" alt="alt">three</p><script>no</script>'
    got = [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.parse_sequence(page)]
    assert got == [(0, "text", "One", None), (1, "media", "ab", "Cap tion"), (2, "text", "Two", None), (3, "media", None, "alt"), (4, "text", "three", None)]
    assert media.parse_sequence(None) == []


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination(spark, make, odd, none):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(200)]
    line = lambda n: " ".join(rng.choice(words, n))
    items = [(k, line(25)) for k in range(6)] + [(6, "short one"), (7, ""), (8, None)]
    texts = []
    for k in range(40):
        t = line(30) + " " + (items[k % 7][1] if k % 2 else "") + " " + line(30)
        t = list(t.upper() if k % 3 == 0 else t)
        for _ in range(k % 9):
            at = int(rng.integers(len(t)))
            t[at : at + 1] = rng.choice(["", "q", "zz"])
        texts.append("".join(t))
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for k, p in items[:7]:
            own, full = decontaminate.compared(t), decontaminate.compared(p)
            budget = int(0.05 * len(full[1:-1])) if len(full[1:-1]) >= 40 else 0
            d = edit_distance_inside(full[1:-1], own) if budget else 0 if full in own else 99
            if d <= budget:
                want.add((i, k, d))
    for block in (4_000_000, 100):
        got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(make(texts), frame, block_chars=block).collect()}
        assert got == want and len(want) > 10
    kept = {r.doc_id for r in decontaminate.keep_clean(make(texts), frame).collect()}
    assert kept == set(range(40)) - {i for i, _, _ in want}
    assert decontaminate.contaminated(odd, frame).count() == 0 and decontaminate.contaminated(none, frame).count() == 0
    assert decontaminate.keep_clean(odd, frame.limit(0)).columns == odd.columns


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article>Read more here</article><div id=content><p>{LONG}</p><p>{LONG}</p></div>", f"Read more here {LONG} {LONG}"),
        (f"<article><p>{LONG}</p><p class='share-price'>{LONG} Up.</p></article>", f"{LONG} {LONG} Up."),
        (f"<article><header><h1>Title</h1></header><p>{LONG}</p></article><header>Site</header>", f"Title {LONG}"),
        (f"<p>{LONG}</p><h2>Comments</h2><ul><li>{LONG} One.</li><li>{LONG} Two.</li></ul><h2>Annex</h2><p>{LONG} End.</p>", f"{LONG} Annex {LONG} End."),
        (f"<article><p>{LONG}</p><h3>3 comments (3)</h3></article>", LONG),
        (f"<p class=share>{LONG} Share.</p><article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG} {LONG}"),
    ],
)
def test_articles_are_weighed_and_class_words_judged(page, text):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == text


def test_candidates_have_no_limit_of_length():
    local, host = "a" * 70, "b" * 70
    assert pii.candidates(f"{local}@{host}.c.d") == [(0, 0, 145)]
    for text, kind in ((f"x{'.y' * 9}(at)h{'.z' * 9}", 0), ("1.22.333.4444.55555.6", 1), ("1" * 40, 2), ("4" + " " * 7 + "1" * 15, 2), ("+1" + "-" * 6 + "234567890123456789", 3)):
        assert any(k == kind and b - a == len(text) for a, k, b in pii.candidates(text)), text
    for kind in range(4):  # the checks take what is too long
        assert all(pii.refuted(t, *c) for t in ("1" * 40, "9" * 9000, "1.2.3.4.5.6") for c in pii.candidates(t) if c[1] == kind and kind != 3 or c[1] == 3 and len(t) > 15)


def plain_ftrl(rows, classes, epochs, alpha, beta, l1, l2):
    """The update as it is written down, a coordinate at a time."""
    z, n = {}, {}

    def weight(i, k):
        s = z.get((i, k), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for at in order.permutation(len(rows)):
            columns, values, y = rows[at]
            s = [sum(v * weight(i, k) for i, v in zip(columns, values)) for k in range(classes)]
            e = [math.exp(x - max(s)) for x in s]
            old = {(i, k): weight(i, k) for i in columns for k in range(classes)}
            for i, v in zip(columns, values):
                for k in range(classes):
                    g = v * (e[k] / sum(e) - (k == y))
                    was = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * old[i, k]
                    n[i, k] = was + g * g
    return weight


def test_ftrl_against_plain():
    rng = np.random.default_rng(3)
    rows = [(rng.choice(50, 6, replace=False), rng.normal(size=6), int(rng.integers(3))) for _ in range(40)]
    got = langid.ftrl([(c, v) for c, v, _ in rows], np.array([y for *_, y in rows]), 3, 2, 0.5, 1.0, 0.05, 0.01)
    want = plain_ftrl(rows, 3, 2, 0.5, 1.0, 0.05, 0.01)
    assert all(abs(got[i, k] - want(i, k)) < 1e-9 for i in range(50) for k in range(3))
    assert (got == 0).any() and (got != 0).any()


def test_document_frequencies_and_scores_against_plain(spark):
    texts = ["ab ab", "ab c", "Ab!", "", "12"]
    df, total = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {}
    for t in texts:
        for g in set(langid.grams(t).tolist()):
            want[g] = want.get(g, 0) + 1
    assert total == 5 and {int(i): int(df[i]) for i in np.flatnonzero(df)} == want
    model = langid.Model(["x", "y"], np.random.default_rng(0).normal(size=(langid.DIMS, 2)), np.array([0.1, -0.2]), 2.0)
    g = langid.grams("ab c")
    z = [(sum(model.weights[i, k] for i in g) / len(g) + model.bias[k]) / 2.0 for k in range(2)]
    assert model.scores("ab c") == pytest.approx([math.exp(x) / sum(map(math.exp, z)) for x in z])


def test_language_stage_keeps_what_the_model_recognises(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs.select("text", "lang"))
    want = {r.doc_id for r in docs.collect() if r.text and langid.LETTER.search(r.text) and model.scores(r.text).max() >= 0.3}
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()} == want
