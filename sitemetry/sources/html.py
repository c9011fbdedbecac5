"""HTML to page features, by a one-pass parser on Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = tuple(f"h{k}" for k in range(1, 7))
_TEXT = ["title", "meta_description", "canonical_url", "robots_directive", "og_title", "og_description", "og_image", "twitter_card", "twitter_title", "twitter_description", "twitter_image", "html_lang"]
_COUNTS = ["word_count", *[f"{h}_count" for h in HEADINGS], "image_count", "images_missing_alt", "external_link_count", "css_file_count", "js_file_count", "iframe_count"]
_FLAGS = ["has_viewport", "has_charset", "has_favicon"]
FEATURES = (
    ", ".join(f"{c} string" for c in _TEXT) + ", is_indexable boolean, " + ", ".join(f"{c} int" for c in _COUNTS) + ", internal_links array<string>, json_ld_types array<string>, " + ", ".join(f"{c} boolean" for c in _FLAGS)
)


#: Characters that stay in a path and in a query; all others are escaped.
_IN_PATH = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in '"<>`{}')
_IN_QUERY = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) not in "\"<>'")


def _without_dots(path: str) -> str:
    done: list[str] = []
    for part in path.split("/")[1:]:
        plain = part.lower().replace("%2e", ".")
        if plain == "..":
            del done[-1:]
        elif plain != ".":
            done.append(part)
    return "/" + "/".join(done)


def normal_url(url: str) -> str | None:
    """Like ``norm_crawl_url``; None if not http(s)."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if parts.scheme.lower() not in ("http", "https") or not host:
        return None
    default = {"http": 80, "https": 443}[parts.scheme.lower()]
    credentials = parts.netloc.rpartition("@")[0]
    place = (f"{credentials}@" if credentials else "") + (host if port in (None, default) else f"{host}:{port}")
    path = _without_dots(parts.path or "/").rstrip("/") or "/"
    query = re.match(r"[^?#]*(\?[^#]*)?", url)[1] or ""
    return f"{parts.scheme.lower()}://{place}{quote(path, safe=_IN_PATH)}{quote(query, safe=_IN_QUERY)}"


def internal_link(href: str, base: str, domain: str) -> str | None:
    """The normalised target of a link inside the domain, else None."""
    try:
        href = href.strip()
        url = href if re.match("[A-Za-z][A-Za-z0-9+.-]*:", href) else urljoin(base, href)
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return None
    root = domain.lower()
    return normal_url(url) if host == root or host.endswith(f".{root}") else None


def _origin(url: str) -> tuple[str, str] | None:
    try:
        parts = urlsplit(url)
        return parts.scheme, parts.netloc.lower()
    except ValueError:
        return None


class _Features(HTMLParser):
    def __init__(self, url: str, domain: str):
        super().__init__(convert_charrefs=True)
        self.url, self.domain = url, domain
        self.text: dict[str, str] = {}
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.flags = dict.fromkeys(_FLAGS, False)
        self.links: dict[str, None] = {}
        self.types: dict[str, None] = {}
        self.words: list[str] = []
        self.inside: str | None = None
        self.ld: list[str] | None = None
        self.in_body = False
        self.named: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in HEADINGS:
            self.counts[f"{tag}_count"] += 1
        if tag == "body":
            self.in_body = True
        elif tag == "html" and "lang" in a:
            self.text.setdefault("html_lang", a["lang"])
        elif tag == "title":
            self.inside = "title" if "title" not in self.text else "other"
            self.text.setdefault("title", "")
        elif tag in ("script", "style"):
            self.inside = tag
            self.counts["js_file_count"] += tag == "script" and "src" in a
            self.ld = [] if a.get("type", "").lower() == "application/ld+json" else None
        elif tag == "iframe":
            self.counts["iframe_count"] += 1
        elif tag == "img":
            self.counts["image_count"] += 1
            self.counts["images_missing_alt"] += not a.get("alt", "").strip()
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            self._link(a)
        elif tag == "a" and a.get("href"):
            target = internal_link(a["href"], self.url, self.domain)
            if target:
                self.links[target] = None
            try:
                origin = _origin(urljoin(self.url, a["href"].strip()))
            except ValueError:
                origin = None
            self.counts["external_link_count"] += origin is not None and origin != _origin(self.url)

    def _meta(self, a):
        content = a.get("content", "").strip()
        for kind in ("property", "name"):
            if a.get(kind):
                self.named.setdefault(f"{kind} {a[kind]}", content)
        if a.get("name") == "description":
            self.text.setdefault("meta_description", content)
        if a.get("name") == "robots":
            self.text.setdefault("robots_directive", a.get("content", ""))
        self.flags["has_viewport"] |= a.get("name") == "viewport"
        self.flags["has_charset"] |= "charset" in a or a.get("http-equiv") == "Content-Type"

    def _link(self, a):
        rel = a.get("rel", "")
        if rel == "canonical" and a.get("href") and "canonical_url" not in self.text:
            target = internal_link(a["href"], self.url, self.domain)
            if target:
                self.text["canonical_url"] = target
        self.flags["has_favicon"] |= rel in ("icon", "shortcut icon")
        self.counts["css_file_count"] += rel == "stylesheet"

    def handle_endtag(self, tag):
        if tag == "script" and self.ld is not None:
            self._schema("".join(self.ld))
            self.ld = None
        if tag in ("script", "style", "title"):
            self.inside = None

    def _schema(self, text):
        try:
            data = json.loads(text)
        except ValueError:
            return
        found = data.get("@type") if isinstance(data, dict) else None
        for t in found if isinstance(found, list) else [found]:
            if isinstance(t, str):
                self.types[t] = None

    def handle_data(self, data):
        if self.inside == "title":
            self.text["title"] += data
        elif self.inside == "script":
            if self.ld is not None:
                self.ld.append(data)
        elif self.in_body and self.inside is None:
            self.words.append(data)

    def row(self) -> dict:
        social = {"og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_image": "twitter:image"}
        for column, name in social.items():
            value = self.named.get(f"property {name}", self.named.get(f"name {name}"))
            if value is not None:
                self.text[column] = value
        if "title" in self.text:
            self.text["title"] = self.text["title"].strip()
        self.counts["word_count"] = len("".join(self.words).split())
        robots = self.text.get("robots_directive")
        indexable = None if robots is None else re.search(r"\bnoindex\b", robots, re.I) is None
        return {c: self.text.get(c) for c in _TEXT} | {"is_indexable": indexable} | self.counts | {"internal_links": list(self.links), "json_ld_types": list(self.types)} | self.flags


def page_features(html: str | None, url: str, domain: str) -> dict:
    parser = _Features(url or "", domain or "")
    parser.feed(html or "")
    parser.close()
    return parser.row()


#: Pages that a task holds as features at a time.
PAGES_AT_A_TIME = 256


def extract_page_features(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, domain, html) to (page_id, url, features...); the HTML goes no further."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = [tuple(c.strip().split(" ")) for c in FEATURES.split(",")]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), *((name, kinds[kind]) for name, kind in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_A_TIME):
                rows = batch.slice(at, PAGES_AT_A_TIME).to_pylist()
                yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "url": r["url"]} | page_features(r["html"], r["url"], r["domain"]) for r in rows], schema)

    columns = [F.col("page_id").cast("bigint").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "domain", "html"))]
    return pages.select(*columns).mapInArrow(run, f"page_id bigint, url string, {FEATURES}")
