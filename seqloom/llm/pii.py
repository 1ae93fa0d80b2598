"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds: everything that looks a little like an address, a
number with dots, a long number or a telephone number. Boosted trees score each candidate by its format and by the
text around it, and a threshold for the wanted precision, found on held-out candidates, selects. Spans of the strict
rules below are always kept; the trees add the ones that the rules miss.

The trees learn from all documents that hold a digit or an at sign, and only about what the strict rules miss. Their candidates
are kept in bins of each feature's values; a level of a tree takes one pass, in which tasks sum gradients by node and bin. Positive ones are strict spans rewritten in place into forms that no strict rule takes: (at) and (dot),
telephone numbers without +, other separators; a form that could be any number comes with a context word. Negative ones
are candidates whose check fails, and clean numbers (amounts, dates, ranges, lists) written in place of strict spans where
no context word stands. All other candidates have no label. The checks themselves are not features: a candidate whose
check fails is never taken. Each kind has a cut of its own, measured on rewritten spans of documents that are held out.

Defined cases: a null or empty text has no spans; offsets count code points, ends are exclusive; equal texts give equal
spans; if there are too few candidates or a class is missing, only the rules speak, for a kind without strict spans too;
of overlapping candidates the likeliest is taken.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import boosting
from seqloom.plans.lineage import discard, materialize

# fixed values: kinds in the order of the result, and what their strict rules look like
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# no limits of length: the checks and the trees decide; a kind may have several forms, whose spans overlap
_AT, _DOT = r"(?:@|\(at\)|\[at\])", r"(?:\.|\s\.\s|\s?(?:\(dot\)|\[dot\])\s?)"
WIDE = {
    "email": [re.compile(rf"(?<![\w.%+-])[\w.%+-]++\s?{_AT}\s?[\w-]++(?:{_DOT}[\w-]++)++")],
    "ip": [re.compile(r"(?<![0-9.])[0-9]++(?:[.,][0-9]++){3,}+")],
    "card": [re.compile(rf"(?<![0-9])[0-9](?:[ .-]{n}[0-9]){{11,}}+") for n in ("{0,2}+", "*+")],
    "phone": [re.compile(rf"(?<![0-9])(?:\+|00|\()?[0-9](?:[ ()./-]{n}[0-9]){{6,}}+") for n in ("{0,3}+", "*+")],
}
CONTEXT = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "host", "server", "address", "addr", "gateway"),
    "card": ("card", "visa", "credit", "payment", "account", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "mobil", "ruf"),
}
NEAR = {kind: re.compile("|".join(rf"(?<![^\W_]){w}" if w.isalpha() else w for w in (*words, *(f"e{w}" for w in words if w == "mail")))) for kind, words in CONTEXT.items()}
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
DATE = re.compile(r"(?<![0-9])(?:(?:1[5-9]|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:1[5-9]|20)[0-9]{2}|(?:1[5-9]|20)[0-9]{2} ?[-/] ?(?:1[5-9]|20)[0-9]{2})(?![0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: the longest run of local characters before each sign, after the last match and sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the strict rules, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    signs, digits = "@" in text or "(at)" in text or "[at]" in text, DIGIT.search(text)
    found = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) if (digits if k else signs) for form in WIDE[kind] for m in form.finditer(text)]
    return list(dict.fromkeys(found))


def feature_row(text: str, start: int, kind: int, end: int) -> list[float]:
    span, left, right = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    groups = re.findall("[0-9]+", span)
    digits = sum(map(len, groups))
    return [
        kind,
        end - start,
        digits,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        int(groups[0]) if groups and len(groups[0]) < 6 else 1e6,
        max((int(x) for x in groups if len(x) < 6), default=1e6),
        sum(c.isalpha() for c in span),
        span.count("."),
        span.count("-") + span.count(" "),
        span.count("(") + span.count("["),
        span.startswith(("+", "00")),
        "@" in span,
        left[-1:].isspace() or not left,
        left[-1:] in "\"'=:#/",
        right[:1].isalnum(),
        right[:1].isspace() or not right,
        NEAR[KINDS[kind]].search(left) is not None,
        any(near.search(left) for k, near in NEAR.items() if k != KINDS[kind]),
        len(set(span)) / (end - start),
        span.count(","),
        span.count("/"),
        len(groups[-1]) if groups else 0,
    ]


def refuted(text: str, start: int, kind: int, end: int) -> bool:
    """Whether the candidate's check fails."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        plain = re.sub(r"\s", "", re.sub(r"\(dot\)|\[dot\]", ".", re.sub(r"\(at\)|\[at\]", "@", span)))
        return not PLAIN_EMAIL.fullmatch(plain)
    if kind == 1:
        groups = re.split("[.,]", span)
        return len(groups) != 4 or any(len(x.lstrip("0")) > 3 or int(x.lstrip("0") or 0) > 255 for x in groups) or bool(re.match("[.,]?[0-9]", text[end : end + 2]))
    if kind == 2:
        return not 13 <= len(digits) <= 19 or not luhn(digits)
    if len(digits) - 2 * span.startswith("00") > 15:
        return True
    glued = re.search(r"[^\W_]+$", text[max(0, start - 40) : start])
    if glued and glued[0].lower() not in CONTEXT["phone"] or text[end : end + 1].isalnum():
        return True  # a piece of a token
    return bool(re.match(r"[ ()./-]{0,3}[0-9]", text[end : end + 4]) or DATE.search(span))  # over 15 digits, or a date


def rewritten(span: str, kind: int, rng: random.Random) -> tuple[str, bool]:
    """A strict span in a form that no strict rule takes, and whether it could be any number without a context word."""
    groups = re.findall("[0-9]+", span)
    if kind == 0:
        local, _, domain = span.rpartition("@")
        if rng.random() < 0.5:
            local = (re.sub("[0-9._]", "", local) or local)[: rng.randint(2, 12)]
        if rng.random() < 0.5:
            host, top = re.sub("[0-9]", "", domain).split(".")[-2:]
            domain = f"{host[: rng.randint(2, 12)] or 'x'}.{top}"
        at, dot = rng.choice([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" @ ", " . ")])
        return local + at + domain.replace(".", dot), False
    if kind == 1:
        return span.replace(".", ","), True
    if kind == 2:
        digits = "".join(groups)
        return rng.choice([".", "  ", "--", ". "]).join(digits[k : k + 4] for k in range(0, len(digits), 4)), False
    if len(groups) > 2 and rng.random() < 0.4:
        groups = groups[1:]  # without the country
    if len(groups) > 2 and rng.random() < 0.3:
        groups = [*groups[:-2], groups[-2] + groups[-1]]
    form = rng.randrange(6)
    if form == 0:
        return "".join(groups), True
    if form == 1 and len(groups) > 1:
        return "00" + " ".join(groups), False
    if form == 2 and len(groups) > 1:
        return f"{groups[0]} ({groups[1]}) {'-'.join(groups[2:])}" if len(groups) > 3 else f"({groups[0]}) {'-'.join(groups[1:])}", False
    return (". -/"[form - 2]).join(groups), len(groups) < 3


def clean_number(rng: random.Random) -> str:
    """What numbers in texts look like that belong to nobody."""
    big = rng.randrange(10 ** rng.randint(6, 11), 10**12)
    year = lambda: rng.randint(1900, 2030)
    return rng.choice(
        [
            str(big),
            f"{big:,}".replace(",", " "),
            f"{big:,}".replace(",", "."),
            " ".join(f"{rng.uniform(0, 100):.{rng.randint(1, 3)}f}" for _ in range(rng.randint(3, 6))),
            " ".join(str(rng.randrange(100)) for _ in range(rng.randint(5, 9))),
            ",".join(str(rng.randrange(200)) for _ in range(4)),
            f"{year()}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}",
            f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year()}",
            f"{year()}-{year()}",
            f"{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}",
            f"{rng.randrange(10**6)}.{rng.randrange(10**6):06d}",
            f"{rng.choice(['only', 'two', 'seen'])} @ {rng.randrange(24)}.{rng.randrange(60):02d}",
        ]
    )


def labelled(text: str) -> list[tuple[list[float], int]]:
    """Training candidates with their class: 1 for a strict span rewritten, 0 where a check fails or a clean number stands."""
    strict = rule_spans(text)
    free = [c for c in candidates(text) if not any(c[0] < b and a < c[2] for a, _, b in strict)]
    out = [(feature_row(text, *c), 0) for c in free if refuted(text, *c)]
    rng = random.Random(zlib.crc32(text.encode()))
    for a, k, b in strict:
        left, right = text[max(0, a - 60) : a], text[b : b + 60]
        for _ in range(3):
            own, unsure = rewritten(text[a:b], k, rng)
            word = rng.choice([w for w in CONTEXT[KINDS[k]] if w.isalpha()]) + rng.choice([" ", ": ", ". "]) if unsure or rng.random() < 0.3 else ""
            at = len(left + word)
            new = left + word + own + right
            out += [(feature_row(new, *c), 1) for c in candidates(new) if c[1] == k and c[0] == at and abs(c[2] - at - len(own)) < 2 and not refuted(new, *c)]
        for _ in range(3):
            own = clean_number(rng)
            new = left + own + right
            near = [c for c in candidates(new) if c[0] < len(left + own) and len(left) < c[2]]
            out += [(feature_row(new, *c), 0) for c in near if not NEAR[KINDS[c[1]]].search(left[-40:].lower())]
    return out


WIDTH = 24  # features
FINE = 1024  # steps of a margin
FEW = 20_000  # candidates that the driver takes


def train(docs: DataFrame, local: int = FEW, precision: float = 0.98) -> tuple[boosting.Trees, list[float]] | None:
    """Trees and a cut for each kind, from the candidates of all documents.

    Up to ``local`` candidates are summed in the driver; of more, tasks sum the gradients of a level, with the same trees.
    """
    holds = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # all candidates of a document on one side
            got = [(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 == 4, f, y) for t in batch["text"] for f, y in labelled(t)]
            yield pd.DataFrame(got, columns=["held", "f", "y"])

    found = materialize(holds.mapInPandas(rows, "held boolean, f array<double>, y int"), "candidates")
    whole = found.agg(F.count("*").alias("n"), F.count_distinct("y").alias("classes")).first()
    if whole.n < 50 or whole.classes < 2:
        discard(found)
        return None
    at = found.where("not held").agg(*(F.percentile(F.get("f", F.lit(j)), boosting.quantiles().tolist()) for j in range(WIDTH))).first()
    edges = [np.unique(np.array(e or [], float)) for e in at]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = np.array(batch.column(1).to_pylist())
                parts = boosting.binned(f, edges), f[:, 0], batch.column(2).to_numpy(), batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([p.astype(np.uint8).tobytes()], pa.binary()) for p in parts], names=["x", "kind", "y", "held"])

    packed = materialize(found.mapInArrow(pack, "x binary, kind binary, y binary, held binary"), "binned")
    discard(found)
    if whole.n <= local:
        own = _unpacked([[r[c] for r in packed.collect()] for c in packed.columns])
        trees = boosting.grow(lambda *state: _gradients(own, *state), edges)
        margins = _margins(own, trees)
    else:
        trees = boosting.grow(lambda *state: _summed(packed, state), edges)

        def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _margins(_unpacked([c.to_pylist() for c in batch.columns]), trees)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got.T], names=["kind", "m", "y", "n"])

        counts = packed.mapInArrow(seen, "kind long, m long, y long, n long").groupBy("kind", "m", "y").agg(F.sum("n").alias("n"))
        margins = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 4)
    discard(packed)
    kind, m, y, n = margins[np.lexsort(margins.T)].T
    if len(set(y.tolist())) == 2:
        trees.slope, trees.shift = boosting.platt(m / FINE, y.astype(float), times=n)
    cuts = []
    for k in range(len(KINDS)):
        each, place = np.unique(m[kind == k], return_inverse=True)
        hits, times = (np.bincount(place, w[kind == k], len(each)) for w in (y * n, n))
        p = 1 / (1 + np.exp(-np.clip(trees.slope * each / FINE + trees.shift, -40, 40)))
        cuts.append(max(0.5, boosting.threshold(p, hits / times, precision, times)))  # over 1 where no span is held out
    return boosting.unbinned(trees, edges), cuts


def _unpacked(columns: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    x, kind, y, held = (np.frombuffer(b"".join(c), np.uint8) for c in columns)
    return x.reshape(-1, WIDTH), kind, y.astype(float), held.astype(bool)


def _gradients(own: tuple[np.ndarray, ...], *state) -> np.ndarray:
    x, _, y, held = own
    return boosting.gradients(x[~held], y[~held], *state)


def _summed(packed: DataFrame, state: tuple) -> np.ndarray:
    """The gradients of all rows: one array a task, whose size does not depend on its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            new = _gradients(_unpacked([c.to_pylist() for c in batch.columns]), *state)
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = packed.mapInArrow(count, "total binary").collect()
    return sum(np.frombuffer(r.total, np.int64) for r in parts).reshape(WIDTH, -1, boosting.BINS, 2)


def _margins(own: tuple[np.ndarray, ...], trees: boosting.Trees) -> np.ndarray:
    """(kind, margin in steps, class, how many) of the rows that are held out."""
    x, kind, y, held = own
    steps = np.floor(trees.margin(x[held]) * FINE)
    rows, n = np.unique(np.stack([kind[held], steps, y[held]], 1).astype(np.int64), axis=0, return_counts=True)
    return np.concatenate([rows, n[:, None]], 1)


OUT = {"n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"}


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, text: str = "text", model: tuple[boosting.Trees, list[float]] | None = None) -> DataFrame:
    """``docs`` with counts of strict spans, their digest, all spans as a string, and the redacted text.

    Columns of ``docs`` with these names are replaced.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    def spans_of(column: pd.Series) -> pd.DataFrame:
        texts = [x or "" for x in column]
        base = [rule_spans(t) for t in texts]
        more: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if model is not None:
            trees, cuts = model
            new = [(i, c) for i, t in enumerate(texts) for c in candidates(t) if not any(c[0] < b and a < c[2] for a, _, b in base[i]) and not refuted(t, *c)]
            if new:
                p = trees.probability(np.array([feature_row(texts[i], *c) for i, c in new]))
                last: dict[int, tuple[int, float]] = {}
                for (i, c), q in sorted(zip(new, p, strict=True), key=lambda x: (x[0][0], x[0][1])):
                    if q >= cuts[c[1]]:
                        end, was = last.get(i, (0, 0.0))
                        if c[0] < end and q <= was:
                            continue
                        if c[0] < end:
                            more[i].pop()
                        more[i].append(c)
                        last[i] = c[2], q
        rows = []
        for t, b, m in zip(texts, base, more, strict=True):
            every = sorted(b + m)
            count = [sum(k == j for _, k, _ in b) for j in range(4)]
            rows.append((*count, hashlib.sha256(joined(b).encode()).hexdigest(), joined(every), redact(t, every) if every else t))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])

    others = [c for c in docs.columns if c.lower() not in OUT]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("own"), spans_of(F.col(text).cast("string")).alias("found")).select("own.*", "found.*")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_in_documents(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return find(base, model=train(base)).drop("text", "redacted")
