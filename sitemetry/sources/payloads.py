"""External JSON payloads to rows: malformed entries are dropped or defaulted, never raised.

Entries are read as variants, so each value keeps its JSON type; a value of another type than the
field's is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round, js_trim
from ..functions.urls import hostname_of, internal_link, path_of

BODY_CHARS, COMMENT_CHARS = 500, 2000
GONE = ["", "[removed]", "[deleted]"]


def _text(value: Column) -> Column:
    return js_trim(F.coalesce(value, F.lit("")))


def _at(entry: Column | str, field: str) -> Column:
    """A field of a JSON value, with its own JSON type; null if it is missing or null."""
    value = F.try_variant_get(entry, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) != "VOID", value)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(kind), F.lit(False))


def _string(value: Column) -> Column:
    """The value of a JSON string; null for any other type."""
    return F.when(_is(value, "^STRING$"), F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    """A finite double from a JSON number; null for any other type."""
    n = F.try_variant_get(value, "$", "double")
    return F.when(_is(value, "^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.abs(n) < float("inf")), n)


def _number_or_text(value: Column) -> Column:
    """A finite double from a JSON number, boolean or text that holds a number, else 0."""
    read = F.when(_is(value, "^STRING$"), js_trim(F.try_variant_get(value, "$", "string")).try_cast("double"))
    read = read.when(_is(value, "^BOOLEAN$"), F.try_variant_get(value, "$", "boolean").cast("double")).otherwise(_number(value))
    return F.when(F.abs(read) < float("inf"), read).otherwise(0.0)


def _count(value: Column) -> Column:
    return F.greatest(F.lit(0), js_round(F.coalesce(_number(value), F.lit(0.0))))


def _author(value: Column) -> Column:
    name = _text(_string(value))
    return F.when((name != "") & (_string(value) != "[deleted]"), name)


def _entries(payloads: DataFrame, keys: list[str], outer: str, items: Callable[[Column], Column], place: str) -> DataFrame:
    """One row for each entry of a payload's array: its place and, as ``r``, the object that it is.

    Entries keep their JSON types; one that is no object takes a place but gives no row.
    """
    rows = payloads.select(*keys, F.posexplode(items(F.from_json("payload", outer))).alias(place, "r"))
    return rows.where(_is(F.col("r"), "^OBJECT"))


def flatten_query_metrics(payloads: DataFrame) -> DataFrame:
    """(site_url, row_ord, keys, clicks, impressions, ctr, position) from (site_url, payload) ``{rows: [...]}``."""
    rows = _entries(payloads, ["site_url"], "rows array<variant>", lambda p: p["rows"], "row_ord")
    keys = F.transform(F.filter(F.try_variant_get("r", "$.keys", "array<variant>"), lambda k: _is(k, "^STRING$")), lambda k: F.try_variant_get(k, "$", "string"))
    numbers = [_number_or_text(_at("r", f)).alias(f) for f in ("clicks", "impressions", "ctr", "position")]
    return rows.select("site_url", "row_ord", keys.alias("keys"), *numbers).where("size(keys) > 0")


def flatten_metric_sites(payloads: DataFrame) -> DataFrame:
    """Distinct (user_id, site_url) from (user_id, payload) ``{siteEntry: [{siteUrl}]}``."""
    rows = _entries(payloads, ["user_id"], "siteEntry array<variant>", lambda p: p["siteEntry"], "place")
    return rows.select("user_id", _text(_string(_at("r", "siteUrl"))).alias("site_url")).where("site_url != ''").distinct()


def map_listing_posts(payloads: DataFrame) -> DataFrame:
    """Posts of a listing ``{data: {children: [{kind, data}]}}`` in (crawl_run_id, query, payload)."""
    rows = _entries(payloads, ["crawl_run_id", "query"], "data struct<children: array<variant>>", lambda p: p["data"]["children"], "post_ord")
    rows = rows.select("crawl_run_id", "query", "post_ord", _at("r", "kind").alias("kind"), _at("r", "data").alias("d")).where(_is(F.col("d"), "^OBJECT") & (~_is(F.col("kind"), "^STRING$") | (_string(F.col("kind")) == "t3")))
    at = lambda field: _at("d", field)
    body, author = _text(_string(at("selftext"))), _string(at("author"))
    out = rows.select(
        "crawl_run_id",
        "query",
        "post_ord",
        _text(_string(at("subreddit"))).alias("subreddit"),
        _text(_string(at("title"))).alias("title"),
        _string(at("permalink")).alias("permalink"),
        F.when((js_trim(author) != "") & (author != "[deleted]"), author).alias("author"),
        _count(at("score")).alias("score"),
        _count(at("num_comments")).alias("num_comments"),
        F.timestamp_seconds(_number(at("created_utc"))).alias("created_at"),
        F.when(body != "", F.substring(body, 1, BODY_CHARS)).alias("body_snippet"),
    )
    return out.where("subreddit != '' and startswith(permalink, '/')").where(~F.col("title").isin(*GONE))


def _moment(value: Column) -> Column:
    """A timestamp from ISO text, or from a number: epoch seconds or milliseconds (from 1e12)."""
    n = _number(value)
    return F.coalesce(F.timestamp_seconds(F.when(n < 1e12, n).otherwise(n / 1000)), F.try_to_timestamp(_string(value)))


def map_flat_items(payloads: DataFrame) -> DataFrame:
    """Posts with their comments from flat arrays of mixed items in (crawl_run_id, query, payload).

    Comments meet their post on its id within a payload.
    """
    at = lambda field: _at("r", field)
    rows = _entries(payloads, ["crawl_run_id", "query"], "array<variant>", lambda p: p, "post_ord").withColumn("type", _string(at("type")))
    key = ["crawl_run_id", "query", "post_id"]
    comment = F.struct(F.col("post_ord").alias("ord"), _author(at("author")).alias("author"), F.substring(_text(_string(at("body"))), 1, COMMENT_CHARS).alias("body"), _count(at("score")).alias("score"), _moment(at("created")).alias("created_at"))
    comments = rows.where("type = 'comment'").select("crawl_run_id", "query", _string(at("postId")).alias("post_id"), comment.alias("c")).where("post_id is not null and c.body != ''")
    comments = comments.groupBy(*key).agg(F.array_sort(F.collect_list("c")).alias("comments"))
    link, body = _string(F.coalesce(at("permalink"), at("url"))), _text(_string(at("selftext")))
    posts = rows.where("type = 'post'").select(
        "crawl_run_id",
        "query",
        "post_ord",
        _string(at("id")).alias("post_id"),
        _text(_string(at("subreddit"))).alias("subreddit"),
        _text(_string(at("title"))).alias("title"),
        F.when(hostname_of(link) != "", path_of(link)).alias("permalink"),
        _author(at("author")).alias("author"),
        _count(at("score")).alias("score"),
        _count(at("numComments")).alias("num_comments"),
        _moment(at("created")).alias("created_at"),
        F.when(body != "", F.substring(body, 1, BODY_CHARS)).alias("body_snippet"),
    )
    kept = posts.where("subreddit != '' and permalink is not null").where(~F.col("title").isin(*GONE))
    shown = F.transform(F.coalesce("comments", F.array()), lambda c: F.struct(c["author"].alias("author"), c["body"].alias("body"), c["score"].alias("score"), c["created_at"].alias("created_at")))
    return kept.join(comments, key, "left").withColumn("comments", F.when(F.col("comments").isNotNull(), shown)).drop("post_id")


def map_grounding_results(payloads: DataFrame, most: int = 10) -> DataFrame:
    """Posts from search grounding ``{grounding: {generic: [{url, title, snippets}]}, sources: {url: {age}}}``."""
    schema = "grounding struct<generic: array<struct<url: string, title: string, snippets: array<string>>>>, sources map<string, struct<age: array<string>>>"
    parsed = payloads.select("crawl_run_id", "query", F.from_json("payload", schema).alias("p"))
    rows = parsed.select("crawl_run_id", "query", "p.sources", F.posexplode("p.grounding.generic").alias("post_ord", "g"))
    url, path = F.col("g.url"), path_of(F.col("g.url"))
    age = F.try_element_at("sources", url)["age"]
    rows = rows.where(F.contains(hostname_of(url), F.lit("reddit.com")) & F.startswith(path, F.lit("/r/")))
    rows = rows.select(
        "crawl_run_id",
        "query",
        "post_ord",
        F.regexp_extract(url, r"/r/([a-zA-Z0-9_]+)", 1).alias("subreddit"),
        _text(F.col("g.title")).alias("title"),
        F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/"))).alias("permalink"),
        F.coalesce(F.try_to_timestamp(F.get(age, F.lit(3))), F.try_to_timestamp(F.get(age, F.lit(1)))).alias("created_at"),
        F.substring(F.get("g.snippets", F.lit(0)), 1, BODY_CHARS).alias("body_snippet"),
        F.transform(F.slice("g.snippets", 2, COMMENT_CHARS), lambda s: F.substring(s, 1, COMMENT_CHARS)).alias("comments"),
    )
    first = F.row_number().over(Window.partitionBy("crawl_run_id", "query", "permalink").orderBy("post_ord"))
    place = F.row_number().over(Window.partitionBy("crawl_run_id", "query").orderBy("post_ord"))
    once = rows.withColumn("__n", first).where("__n = 1 and subreddit != ''").where(~F.col("title").isin(*GONE)).drop("__n")
    return once.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def extract_answer_text(payload: Column) -> Column:
    """Text of a model payload's first candidate, white space collapsed; '' if malformed."""
    schema = "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>"
    parts = F.get(F.from_json(payload, schema)["candidates"], F.lit(0))["content"]["parts"]
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(js_trim(F.regexp_replace(joined, r"\s+", " ")), F.lit(""))


def extract_sitemap_urls(files: DataFrame) -> DataFrame:
    """Distinct (crawl_run_id, url) inside the domain from (crawl_run_id, domain, sitemap_url, body) sitemaps; entries may be relative."""
    locs = files.select("crawl_run_id", "domain", "sitemap_url", F.explode(F.regexp_extract_all("body", F.lit(r"(?is)<\s*loc\s*>(.*?)<\s*/\s*loc\s*>"), F.lit(1))).alias("loc"))
    url = js_trim(F.col("loc"))
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'")):
        url = F.replace(url, F.lit(entity), F.lit(char))
    return locs.select("crawl_run_id", internal_link(url, F.col("sitemap_url"), F.col("domain")).alias("url")).where("url is not null").distinct()


def detect_cdn(server: Column, headers: Column) -> Column:
    """CDN of a response by its server header or marker headers; the first match counts."""
    name = F.lower(F.coalesce(server, F.lit("")))
    has = lambda k: F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit("")) != ""
    out = None
    for word, marker, label in (
        ("cloudflare", "cf-ray", "Cloudflare"),
        ("cloudfront", "x-amz-cf-id", "Cloudfront"),
        ("fastly", "x-fastly-request-id", "Fastly"),
        ("akamai", "x-akamai-request-id", "Akamai"),
        ("vercel", "x-vercel-id", "Vercel"),
        ("netlify", "x-nf-request-id", "Netlify"),
    ):
        hit = F.contains(name, F.lit(word)) | has(marker)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    imperva = F.contains(F.lower(F.coalesce(F.try_element_at(headers, F.lit("x-cdn")), F.lit(""))), F.lit("imperva")) | has("x-iinfo")
    return out.when(imperva, "Imperva")
