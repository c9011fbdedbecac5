"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. Words score by where they stand, tags score
below zero; the contiguous stretch of highest total score, found in one scan, is the content.
The weights are learned from labelled pages, those that mark their content with ``article`` or
``main``: they are log-odds of standing inside the mark. A stretch that touches a marked element
grows to its edges, any other to those of the nearest element around it whose words it mostly has, so
short first and last parts stay. Inside the stretch, what stands in a menu, header, footer,
sidebar, notice, advert, form, script, style or comment list is left out.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import pieces

#: Labelled pages that the weights are learned from, about, and different features that are kept, at most.
SAMPLE_PAGES, MAX_FEATURES = 4000, 4096
#: A feature seen less often than this falls back on a more general one.
ENOUGH = 20
#: Weights without evidence: words in links, other words, and tags.
LINK_WORD, PLAIN_WORD, TAG = -1.5, 1.0, -0.2

# Elements of the HTML standard by their role.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "title",
}
NESTING = BLOCKS - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "title"} | {"button", "select", "svg", "annotation", "annotation-xml", "canvas", "object", "template", "video", "audio", "label"}
CONTENT = {"article", "main"}
LEFT_OUT = {
    "nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "button": "form", "select": "form", "label": "form", "search": "form",
    "svg": "script", "annotation": "script", "annotation-xml": "script", "canvas": "script", "object": "script", "template": "script", "video": "script", "audio": "script", "dialog": "notice",
}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "menu": "menu"}
# Words of class and id names, by what they mark.
NAMES = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "skip"},
    "header": {"masthead", "topbar", "banner"},
    "footer": {"footer", "copyright", "colophon"},
    "sidebar": {"sidebar", "widget", "widgets", "related", "recommended", "trending", "share", "sharing", "social"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "alert", "disclaimer", "paywall"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adsbygoogle"},
    "comments": {"comment", "comments", "commentlist", "disqus", "replies", "respond", "discussion", "reviews"},
}
# Names that a part of an article may have for its subject, as a paper's discussion.
DOUBTFUL = NAMES["menu"] | {"related", "recommended", "trending", "share", "sharing", "social", "notice", "notices", "alert", "disclaimer", "promotion", "copyright", "replies", "respond", "discussion", "reviews"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A stretch grows to an element without mark around it if it has this share of the element's words that are not left out.
FILLED = 0.7

# Words that say where or how a part stands. A class or id name marks a part if it has no other words.
PLAIN_NAME_WORDS = {
    "area", "article", "bar", "block", "blog", "body", "bottom", "box", "btn", "button", "col", "column", "container", "content", "entry", "extra", "fixed", "form", "global", "group",
    "header", "holder", "icon", "inline", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "posts", "primary", "region",
    "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "text", "title", "to", "top", "unit", "wrap", "wrapper",
}
_KIND_OF_NAME = {name: kind for kind, names in NAMES.items() for name in names}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_SPACE = re.compile(r"\s+")
#: A page without such a tag has no content element.
_LABEL = rf"(?i)<({'|'.join(sorted(CONTENT))})[\s/>]"


def _marked(tag: str, attributes: str, in_content: bool) -> tuple[str | None, bool]:
    """What a start tag opens that is left out, if anything, and whether only a doubtful name says so."""
    if tag in LEFT_OUT:
        return LEFT_OUT[tag], False
    if tag == "header" and not in_content:
        return "header", False
    if not attributes or tag in ("html", "body", *CONTENT):
        return None, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "script", False
    if (role := found.get("role", "").lower()) in ROLES:
        return ROLES[role], False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = [w.lower() for w in _NAME_WORDS(name)]
        telling = [w for w in words if w in _KIND_OF_NAME]
        if telling and all(w in _KIND_OF_NAME or w in PLAIN_NAME_WORDS for w in words):
            return _KIND_OF_NAME[telling[0]], all(w in DOUBTFUL for w in telling)
    return None, False


@dataclass
class _Open:
    """An open element: what it is left out as, or would be if it proves to be no part of the article."""

    tag: str
    start: int
    kind: str | None = None
    doubt: str | None = None
    before: tuple[int, int, int] = (0, 0, 0)  # headings, words and words in links up to here


def _without_furniture(items: list[tuple], furniture: list[tuple[int, int, str]]) -> list[tuple]:
    """``items`` with those in the given ranges (from, to, kind) left out; ranges are nested or apart."""
    ranges, open_, out, k = sorted(furniture, key=lambda r: (r[0], -r[1])), [], [], 0
    for i, item in enumerate(items):
        while open_ and open_[-1][1] <= i:
            open_.pop()
        while k < len(ranges) and ranges[k][0] <= i:
            if ranges[k][1] > i:
                open_.append(ranges[k])
            k += 1
        if open_ and item[0] == "text" and not item[3]:
            item = ("text", item[1], (open_[-1][2], *item[2][1:]), True, *item[4:])
        out.append(item)
    return out


def read_page(page: str) -> tuple[list[tuple], list[tuple[str, int, int]]]:
    """The page as ('tag', name, inside) and ('text', text, feature, left out, block, inside) items, and its elements.

    ``feature`` is (container, block element, in a link); ``inside`` says whether the item stands
    in a content element; items of the same ``block`` are one block of text. An element is (name, first item,
    item behind it). A part of a content element with a doubtful name is left out if it has no heading of
    its own or more words in links than others.
    """
    items: list[tuple] = []
    elements: list[tuple[str, int, int]] = []
    furniture: list[tuple[int, int, str]] = []
    stack: list[_Open] = []
    element, link, block, at, in_content, outside, doubts = "body", False, 0, 0, 0, 0, 0
    headings = words = linked = 0

    def close() -> _Open:
        nonlocal outside, in_content, doubts
        top = stack.pop()
        outside -= top.kind is not None
        in_content -= top.tag in CONTENT
        elements.append((top.tag, top.start, len(items)))
        if top.doubt:
            doubts -= 1
            if headings == top.before[0] or 2 * (linked - top.before[2]) > words - top.before[1]:
                furniture.append((top.start, len(items), top.doubt))
        return top

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            text = m[0]
            if text[:2] in ("<!", "<?") and len(text) > 1:
                continue
            if not text.isspace() or items:
                container = next((e.kind for e in reversed(stack) if e.kind), "content" if in_content else "page")
                if doubts and not outside:
                    n = len(text.split())
                    words, linked = words + n, linked + n * link
                items.append(("text", text, (container, element, link), outside > 0, block, in_content > 0))
            continue
        if m[2] is None and not page[m.end() - 1] == ">":
            break  # a tag cut off by the end of the page
        tag = tag.lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag in BLOCKS:
                block += 1
            continue
        if tag in BLOCKS or tag in CONTENT:
            block += 1
            link = False
        elif tag == "a":
            link = not closing
        elif tag == "br":
            items.append(("text", " ", ("page", element, link), outside > 0, block, in_content > 0))
        items.append(("tag", tag, in_content > 0))
        headings += tag in HEADINGS and not closing and not outside
        if tag in NESTING:
            if closing:
                if any(e.tag == tag for e in stack):
                    while close().tag != tag:
                        pass
                element = stack[-1].tag if stack else "body"
            elif not attributes.rstrip().endswith("/") or tag in BLOCKS:
                if tag == "li" and stack and stack[-1].tag == "li":
                    close()
                kind, doubtful = _marked(tag, attributes, in_content > 0)
                doubtful = doubtful and in_content > 0
                stack.append(_Open(tag, len(items) - 1, None if doubtful else kind, kind if doubtful else None, (headings, words, linked)))
                doubts += doubtful
                outside += kind is not None and not doubtful
                in_content += tag in CONTENT
                element = tag
        elif tag in BLOCKS:
            element = (stack[-1].tag if stack else "body") if closing else tag
    while stack:
        close()
    return _without_furniture(items, furniture) if furniture else items, elements


def _counts(page: str) -> Counter:
    """(feature, inside) counts of a labelled page; empty if it has no content element."""
    items, _ = read_page(page)
    found: Counter = Counter()
    if not any(i[-1] for i in items):
        return found
    for i in items:
        if i[0] == "tag":
            found[f"tag {i[1]}", i[2]] += 1
        elif n := len(i[1].split()):
            container, element, link = i[2]
            found[f"word {container} {element} {link}", i[5]] += n
            if not i[3]:  # the general feature is for words of no marked part
                found[f"word {element} {link}", i[5]] += n
    return found


def learn_weights(pages: DataFrame) -> dict[str, float]:
    """Weights of features from about SAMPLE_PAGES pages with an article or main tag, picked by a hash of the page.

    Log-odds of standing in a content element, within plus or minus 4; tags between -0.3 and -0.05.
    """
    rows = pages.where(F.col("html").rlike(_LABEL)).select("html", F.xxhash64("html").alias("draw"))
    total = max(1, rows.count())
    share = min(1.0, SAMPLE_PAGES / total)
    sample = rows.where(F.pmod("draw", F.lit(1 << 40)) < int(share * (1 << 40))).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in pieces(batches):
            for page in batch.column(0).to_pylist():
                found.update(_counts(page))
        keys = list(found)
        yield pa.RecordBatch.from_pydict(
            {"feature": pa.array([k[0] for k in keys], pa.string()), "inside": pa.array([k[1] for k in keys], pa.bool_()), "n": pa.array([found[k] for k in keys], pa.int64())}
        )

    sums = sample.mapInArrow(run, "feature string, inside boolean, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b")
    )
    weights = {}
    for r in sums.orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(MAX_FEATURES).collect():
        if r["a"] + r["b"] >= ENOUGH:
            odds = math.log((r["a"] + 0.5) / (r["b"] + 0.5))
            weights[r["feature"]] = min(-0.05, max(-0.3, odds / 8 - 0.2)) if r["feature"].startswith("tag ") else min(4.0, max(-4.0, odds))
    return weights


def _score(item: tuple, weights: dict[str, float]) -> float:
    if item[0] == "tag":
        return weights.get(f"tag {item[1]}", TAG)
    _, text, (container, element, link), left_out, _, _ = item
    if not (words := len(text.split())):
        return 0.0
    if left_out:
        # Marked parts are no content; inside an article they must not tear it apart, and never draw the stretch.
        return min(0.0, weights.get(f"word {container} {element} {link}", -0.05)) * words if container in ("menu", "footer", "header") else -0.05 * words
    specific = weights.get(f"word {container} {element} {link}")
    if specific is None:
        specific = weights.get(f"word {element} {link}", LINK_WORD if link else PLAIN_WORD)
    if container == "content":
        specific = max(specific, 0.5)
    return specific * words


def _grown(items: list[tuple], elements: list[tuple[str, int, int]], ends: list[int]) -> tuple[int, int]:
    """The range of a stretch with the kept texts ``ends``, grown to the edges of the elements it belongs to."""
    a, b = ends[0], ends[-1] + 1
    touched = lambda x, y: (k := bisect_left(ends, x)) < len(ends) and ends[k] < y
    marks = [(x, y) for tag, x, y in elements if tag in CONTENT and touched(x, y)]
    if marks:
        return min(a, min(m[0] for m in marks)), max(b, max(m[1] for m in marks))
    around = [(y - x, x, y) for tag, x, y in elements if x <= a and y >= b and tag not in ("html", "body")]
    if around:
        _, x, y = min(around)
        kept = lambda i: len(i[1].split()) if i[0] == "text" and not i[3] else 0
        if sum(map(kept, items[a:b])) >= FILLED * sum(map(kept, items[x:y])):
            return x, y
    return a, b


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the best stretch, white space collapsed, joined by line feeds; '' if nothing scores."""
    items, elements = read_page(page)
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for i, item in enumerate(items):
        if total <= 0:
            total, start = 0.0, i
        total += _score(item, weights)
        if total > best:
            best, best_from, best_to = total, start, i + 1
    if best <= 0:
        return ""
    ends = [i for i in range(best_from, best_to) if items[i][0] == "text" and not items[i][3]]
    if not ends:
        return ""
    best_from, best_to = _grown(items, elements, ends)
    first, last = ([i[4] for i in items[best_from:best_to] if i[0] == "text" and not i[3]][k] for k in (0, -1))  # whole blocks only
    blocks: dict[int, list[str]] = {}
    for item in items:
        if item[0] == "text" and not item[3] and first <= item[4] <= last:
            blocks.setdefault(item[4], []).append(item[1])
    texts = (_SPACE.sub(" ", "".join(map(html.unescape, b))).strip() for b in blocks.values())  # a reference ends at a tag
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Defined cases: a null or empty page, or one without words, has the text ''; a page without markup
    is one block; equal stretches go to the first; repeated rows are each read; null ids and urls are
    kept; an empty table gives an empty one; other columns are not read.
    """
    weights = learn_weights(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(p, weights) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
