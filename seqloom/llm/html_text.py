"""Main text of web pages by line-block distribution.

Markup is stripped to lines (blocks), each weighed by its characters outside links; boilerplate elements are left out
while stripping. Sums over sliding windows of lines give the distribution; a surge is where a window rises over the
threshold, a dive where it falls to nothing, and the lines between are kept. Lines inside an article or main element
weigh at least a full window, so short paragraphs at its ends stay, and where articles hold most of the page's unlinked text,
lines outside weigh nothing. A short line that only names comments or replies ends the text up to the next heading.

Class and id values are judged by whole tokens: has-sidebar or page-with-header say what lies inside; of paragraphs and
headings only by tokens that are a boilerplate word and nothing else. The header of an article belongs to it. A form, or an element
with a boilerplate word, that holds most of the page's unlinked text is a wrapper and stays, and the window sums decide. An
article ends an unclosed element of that sort, but one that is marked, or lies in an element marked, as comments or related
items is left out.

Defined cases: null or empty html gives an empty text; a page without any weighty line gives an empty text; an unclosed
comment or script runs to the end of the page; after an attribute quote that never closes, tags end at the first ``>``.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names, class words and roles
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object"}
BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BODY = {"article", "main"}
SOFT = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
BOILERPLATE = set(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies copyright"
    " disqus disclaimer discussion footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager"
    " pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription taboola toolbar warning widget".split()
)
ASIDES = set("comment comments comentarios disqus discussion recommended related replies reply respond".split())  # these words count for articles too
MODIFIERS = {"has", "with", "no", "not", "without"}
STATES = MODIFIERS | {"open", "closed", "enabled", "disabled", "allowed"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
TEXTS = HEADINGS | {"p", "span", "b", "i", "em", "strong", "td", "th", "dd", "dt", "blockquote", "pre"}
SAID = re.compile(r"(?:[0-9]+ )?(?:(?:reader|user) )?(?:comments?|comentarios|commentaires|kommentare?|replies|responses|discussion|leave a (?:reply|comment))(?: ?\([0-9]+\))?:?", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form"}

TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)


def boilerplate(tag: str, attributes: str) -> str:
    """"firm" for what is always left out, "hidden" if an article inside ends it, "soft" if it may also be a wrapper, else ""."""
    if tag in DROPPED:
        return "soft" if tag == "form" else "firm"
    if tag in ("html", "body") or not attributes:
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for token in value.split():
                words = re.split(r"[^a-z]+", token)
                if not (STATES if tag in BODY else MODIFIERS).isdisjoint(words):
                    continue
                if tag in TEXTS and len([w for w in words if w]) > 1:
                    continue
                if not ASIDES.isdisjoint(words):
                    return "firm"
                if tag not in BODY and not BOILERPLATE.isdisjoint(words):
                    found = found or "soft"
        elif tag not in BODY:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "role" and value in ROLES):
                found = "hidden"
    return found


def lines_of(page: str, least: int = 80) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, whether in an article, whether a heading) of every block outside boilerplate, in page order."""
    out, held, total = parsed(page, frozenset())
    wrappers = frozenset(start for start, own in held.items() if own >= least and 2 * own > total)
    return parsed(page, wrappers)[0] if wrappers else out


def parsed(page: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int, bool, bool]], dict[int, int], int]:
    """Lines of the page; unlinked characters in each soft element by its place, and in all. ``wrappers`` are not left out."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[str] = []  # open elements
    marks: list[tuple[str, int, int]] = []  # what boilerplate each is, its place and the characters before it
    held: dict[int, int] = {}
    total = firm = out_of_sight = 0
    dropped: int | None = None  # depth of the boilerplate element that is being left out
    body = link = 0
    at, n, pattern = 0, len(page), TAG

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, body > 0, not HEADINGS.isdisjoint(stack)))
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal dropped, body, link, firm, out_of_sight
        for x, (kind, start, before) in zip(stack[to:], marks[to:], strict=True):
            body -= x in BODY
            link -= x == "a"
            firm -= kind == "firm"
            out_of_sight -= kind == "hidden"
            if kind == "soft":
                held[start] = total - before
        del stack[to:], marks[to:]
        if dropped is not None and len(stack) <= dropped:
            dropped = None

    while at < n:
        lt = page.find("<", at)
        data = page[at : lt if lt >= 0 else n]
        if data and not link and not firm and not out_of_sight:
            total += len(data.strip())
        if data and dropped is None:
            data = html.unescape(data)
            parts.append(data)
            linked += len(data.strip()) if link else 0
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
            continue
        m = pattern.match(page, lt + 1)
        if m is None and pattern is TAG and (m := PLAIN.match(page, lt + 1)):
            pattern = PLAIN
        if m is None:
            if page[lt + 1 : lt + 2].isalpha() or page[lt + 1 : lt + 2] == "/":
                end = page.find(">", lt)  # a broken tag: up to its end, or the page's
                at = end + 1 if end >= 0 else n
            else:
                if dropped is None:
                    parts.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in BLOCKS and dropped is None:
            end_line()
        if m[1]:
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            gt = page.find(">", end.end()) if end else -1
            at = gt + 1 if gt >= 0 else n
            continue
        if tag in SOFT and tag in stack and not {"ul", "ol", "table", "dl"} & set(stack[len(stack) - stack[::-1].index(tag) :]):
            close(len(stack) - 1 - stack[::-1].index(tag))  # its end tag was left out
        elif tag in BLOCKS and stack and stack[-1] == "p":
            close(len(stack) - 1)
        kind = "" if tag == "header" and body else boilerplate(tag, m[3])
        if tag in BODY and dropped is not None and not firm and not kind:
            close(dropped)  # an article never lies in an unclosed advert or notice
        if tag in VOID or m[3].endswith("/"):
            continue
        if dropped is None and kind and lt not in wrappers:
            end_line()
            dropped = len(stack)
        stack.append(tag)
        marks.append((kind, lt, total))
        firm += kind == "firm"
        out_of_sight += kind == "hidden"
        body += tag in BODY
        link += tag == "a"
    if dropped is None:
        end_line()
    close(0)
    return out, held, total


def main_text(page: str | None, window: int = 3, threshold: int = 80) -> str:
    lines, said = [], False
    for line in lines_of(page or ""):
        said = bool(SAID.fullmatch(line[0])) if line[3] else said
        lines += [] if said else [line]
    if not lines:
        return ""
    shown = [0, 0]
    for text, linked, body, _ in lines:
        shown[body] += len(text) - linked
    inside = shown[1] > shown[0]
    weights = []
    for text, linked, body, _ in lines:
        own = len(text) - linked
        own = 0 if 2 * own < len(text) else own
        weights.append(max(own, threshold) if body and inside else 0 if inside else own)
    half = window // 2
    ahead = [0]
    for w in weights:
        ahead.append(ahead[-1] + w)
    sums = [ahead[min(len(weights), i + half + 1)] - ahead[max(0, i - half)] for i in range(len(weights))]
    bar = min(threshold, 0.3 * max(sums))
    kept, k = [], 0
    while k < len(lines):
        if sums[k] > 0 and sums[k] >= bar:
            surge = dive = k
            while surge > 0 and sums[surge - 1] > 0:
                surge -= 1
            while dive + 1 < len(lines) and sums[dive + 1] > 0:
                dive += 1
            kept += [lines[i][0] for i in range(surge, dive + 1) if weights[i] > 0]
            k = dive
        k += 1
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text and its number of code points; columns of these names are replaced."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    return pages.withColumn(out, text_of(F.col(html_col).cast("string"))).withColumn("n_chars", F.length(out).cast("long"))
