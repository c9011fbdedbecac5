"""Queries of sources, sinks and URL functions, with their oracles.

Payloads are built from the given tables, so that parsing them must give the tables' rows back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import content, links, stats
from ..sources import html, payloads, tables
from .audit_queries import ORACLE_SQL as AUDIT_SQL
from .planning_queries import PLAN_SQL, _plan
from .search_queries import OPP_SQL, search_with
from .site_tables import HTML_SQL, crawl_runs, crawled_pages, stored_pages

AGENT = "SiteBot/1.0 (+https://bot.example)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _urls(**columns):
    return lambda s, d: _read(s, d, "pages").select("page_id", *[f(F.col("url")).alias(n) for n, f in columns.items()])


#: Entries of a payload, at most: payloads hold neighbouring ids, so their size doesn't grow with the table.
ENTRIES = 50


def _payload_of(key):
    return F.floor(key / ENTRIES).cast("string")


def _metric_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search metrics as their provider sends them; keys and numbers of other types are mixed in."""
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    key = lambda c: F.to_json(F.struct(F.col(c).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("k")))) - 6)
    keys = F.when(i % 9 == 0, F.lit("[9, null, true]")).otherwise(F.concat(F.lit("[5, "), key("source"), F.lit(", null, "), key("lang"), F.lit("]")))
    impressions = F.when(i % 7 == 0, '"many"').when(i % 7 == 1, F.concat(F.lit('" '), (i % 900).cast("string"), F.lit(' "'))).otherwise((i % 900).cast("string"))
    row = F.concat(F.lit('{"keys": '), keys, F.lit(', "clicks": '), (i % 50).cast("string"), F.lit(', "impressions": '), impressions, F.lit(', "position": '), (i % 100 / 4).cast("string"), F.lit("}"))
    rows = d.groupBy(_payload_of(i).alias("site_url")).agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("r")))).alias("x"))
    return rows.select("site_url", F.concat(F.lit('{"rows": ['), F.array_join("x.r", ", "), F.lit("]}")).alias("payload"))


def _site_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit(" "), U.origin_of(F.col("url")), F.lit("/ "))
    p = _read(spark, sf_dir, "pages").select((F.col("page_id") % 9).alias("user_id"), _payload_of(F.col("page_id")).alias("block"), F.struct(F.when(F.col("page_id") % 11 > 0, url).alias("siteUrl"), F.col("page_id").alias("n")).alias("e"))
    return p.groupBy("user_id", "block").agg(F.to_json(F.struct(F.collect_list("e").alias("siteEntry"))).alias("payload"))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of posts; every 19th title is a number, every 23rd score a text."""
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    value = lambda v: F.try_variant_get(F.parse_json(F.to_json(F.struct(v.alias("v")))), "$.v", "variant")
    title = F.when(i % 19 == 0, value(i)).otherwise(value(F.when(i % 13 == 0, "[removed]").otherwise(F.concat(F.lit(" Post "), i.cast("string")))))
    score = F.when(i % 23 == 0, value(i.cast("string"))).otherwise(value(i - 10))
    data = F.struct(
        F.concat(F.lit("r"), (i % 7).cast("string")).alias("subreddit"),
        title.alias("title"),
        F.concat(F.when(i % 11 == 0, "x").otherwise("/r/"), i.cast("string")).alias("permalink"),
        F.when(i % 5 == 0, "[deleted]").otherwise("me").alias("author"),
        score.alias("score"),
        (i % 60).alias("num_comments"),
        (i * 1000 + 1_700_000_000).alias("created_utc"),
        F.when(i % 3 == 0, "").otherwise(F.col("text")).alias("selftext"),
    )
    child = F.struct(F.when(i % 4 == 0, None).when(i % 17 == 0, "t1").otherwise("t3").alias("kind"), data.alias("data"))
    g = d.groupBy(_payload_of(i).alias("crawl_run_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", F.to_json(child).alias("c")))).alias("x"))
    return g.select("crawl_run_id", F.lit("q").alias("query"), F.concat(F.lit('{"data": {"children": ['), F.array_join("x.c", ", "), F.lit("]}}")).alias("payload"))


def _flat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is a comment on the post before it."""
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    item = F.struct(
        F.when(i % 3 == 2, "comment").otherwise("post").alias("type"),
        F.concat(F.lit("p"), i.cast("string")).alias("id"),
        F.concat(F.lit("p"), (i - i % 3).cast("string")).alias("postId"),
        F.lit("sub").alias("subreddit"),
        F.concat(F.lit("Post "), i.cast("string")).alias("title"),
        F.concat(F.lit("https://forum.example/r/sub/"), i.cast("string")).alias("url"),
        F.lit("me").alias("author"),
        (i % 90).alias("score"),
        F.when(i % 2 == 0, i * 1000 + 1_700_000_000_000).otherwise(i + 1_700_000_000).alias("created"),
        F.concat(F.lit("body "), i.cast("string")).alias("body"),
    )
    g = d.groupBy(F.floor(i / 30).cast("string").alias("crawl_run_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("c")))).alias("x"))
    posts = payloads.map_flat_items(g.select("crawl_run_id", F.lit("q").alias("query"), F.to_json("x.c").alias("payload")))
    return posts.select("crawl_run_id", "post_ord", "title", "permalink", "score", "created_at", F.transform(F.coalesce("comments", F.array()), lambda c: c["body"]).alias("comments"))


def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    url = F.concat(F.when(i % 7 == 0, "https://elsewhere.test/r/").otherwise("https://www.reddit.com/r/"), F.lit("sub/comments/"), (i % 400).cast("string"))
    item = F.struct(url.alias("url"), F.concat(F.lit("Post "), i.cast("string")).alias("title"), F.array(F.lit("first"), F.lit("second")).alias("snippets"))
    age = F.struct(F.array(F.lit(""), F.lit("2024-01-02"), F.lit(""), F.when(i % 2 == 0, "2024-01-03T00:00:00Z").otherwise("soon")).alias("age"))
    g = d.groupBy(F.floor(i / 30).cast("string").alias("crawl_run_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("c"), age.alias("a")))).alias("x"))
    sources = F.map_from_entries(F.transform("x", lambda e: F.struct(e["c"]["url"], e["a"])))
    payload = F.to_json(F.struct(F.struct(F.col("x.c").alias("generic")).alias("grounding"), sources.alias("sources")))
    return payloads.map_grounding_results(g.select("crawl_run_id", F.lit("q").alias("query"), payload.alias("payload"))).drop("query")


def _answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.substring("text", 1, 30).alias("text")), F.struct(F.expr("substring(text, 31)").alias("text")))
    payload = F.when(F.col("conv_id") % 10 == 0, '{"candidates": 5}').otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"))))
    return c.select("conv_id", "turn", payloads.extract_answer_text(payload).alias("answer"))


def _robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = crawled_pages(spark, sf_dir).select(F.col("crawl_run_id").alias("host")).distinct()
    general = "# rules\r\nUser-agent: *\nUser-Agent: other\nDisallow: /de/\nAllow: /de/t\nDisallow:\nDisallow: /fr/*th\nSitemap: https://x/s.xml\n"
    body = F.when(F.length("host") % 3 == 0, F.lit(general + "\nUser-agent: SiteBot\nDisallow: /en/a\n")).otherwise(F.lit(general))
    return hosts.select("host", F.concat(body, F.when(F.length("host") % 2 == 0, F.concat(F.lit("\nSITEMAP : https://"), "host", F.lit("/map.xml\n"))).otherwise(F.lit(""))).alias("body"))


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.parse_robots(_robots_files(spark, sf_dir))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = crawled_pages(spark, sf_dir).select(F.col("crawl_run_id").alias("host"), "url")
    return links.robots_allowed(p, _robots(spark, sf_dir), AGENT)


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = crawled_pages(spark, sf_dir)
    fetched = p.where("page_seq % 2 = 0")
    found = links.discovered_urls(p, crawl_runs(p))
    return links.crawl_frontier(found, fetched, _robots(spark, sf_dir), AGENT, 5)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    part = lambda k: (i * k % 256).cast("string")
    host = F.when(i % 50 == 0, "Localhost.").when(i % 50 == 1, F.concat(F.lit("a"), i.cast("string"), F.lit(".example.org"))).otherwise(F.concat_ws(".", part(7), part(3), part(5), part(1)))
    return links.private_target_filter(_read(spark, sf_dir, "events").select("event_id", host.alias("host")))


def _cdn(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    headers = F.when(i % 5 == 0, F.create_map(F.lit("x-vercel-id"), F.lit("1"))).when(i % 5 == 1, F.create_map(F.lit("x-cdn"), F.lit("Imperva 2")))
    server = F.when(i % 3 == 0, "CloudFlare").when(i % 3 == 1, "nginx")
    return _read(spark, sf_dir, "pages").select("page_id", payloads.detect_cdn(server, headers).alias("cdn"))


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the results of half the crawls, then of all, twice: every crawl's rows are there once."""
    rows = stats.http_status_distribution(crawled_pages(spark, sf_dir))
    path = f"{tables.checkpoint_folder(spark)}/results-{uuid.uuid4().hex}"
    tables.replace_results(rows.where(F.length("crawl_run_id") % 2 == 0), path, 8)
    for _ in range(2):
        tables.replace_results(rows, path, 8)
    return tables.kept_result(tables.read_table(spark, path).select("crawl_run_id", "status_code", "pages"), path)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages").withColumn("domain", U.hostname_of(F.col("url")))
    return html.extract_page_features(p).withColumn("internal_links", F.array_sort("internal_links"))


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other entry is relative to its sitemap, which lies in a folder."""
    p = crawled_pages(spark, sf_dir)
    shown = F.when(F.col("page_seq") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://[^/]*/", "../"))
    loc = F.concat(F.lit("<url>< loc> "), shown, F.lit("/?a=1&amp;b=2#x </loc></url><url><LOC>https://elsewhere.test/</LOC></url>"))
    files = p.groupBy("crawl_run_id", U.scheme_of(F.col("url")).alias("scheme"), _payload_of(F.col("page_seq"))).agg(F.array_join(F.collect_list(loc), "\n").alias("body"))
    return payloads.extract_sitemap_urls(files.withColumn("domain", F.col("crawl_run_id")).withColumn("sitemap_url", F.concat("scheme", F.lit("://"), "crawl_run_id", F.lit("/maps/sitemap.xml"))))


def _internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every kind on the given pages, seen from their addresses."""
    i, url = F.col("page_id"), F.col("url")
    kinds = ["../up/./a b/#x", None, "//www.Example.com:443/x/?q#f", "?page=2#top", "mailto:a@example.com", None, " ", "https://example.com.evil.test/"]
    href = F.when(i % 8 == 1, F.concat(F.lit("/moved/"), i.cast("string"), F.lit("/"))).when(i % 8 == 5, url).otherwise(F.get(F.array(*[F.lit(k) for k in kinds]), (i % 8).cast("int")))
    return _read(spark, sf_dir, "pages").select("page_id", U.internal_link(href, url, F.lit("Example.COM")).alias("normal"))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = stored_pages(spark, sf_dir)
    edges = links.link_graph(pages)
    return _plan(lambda plan: content.content_link_suggestions(plan, pages, edges))(spark, sf_dir)


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where redirects of the given pages lead; the Location headers are derived from ``page_id``."""
    i, url = F.col("page_id"), F.col("url")
    location = F.when(i % 4 == 0, "../up/./a b/#x").when(i % 4 == 1, F.concat(F.lit("/moved/"), i.cast("string"), F.lit("/"))).when(i % 4 == 2, "https://elsewhere.test/").otherwise("?page=2#top")
    return _read(spark, sf_dir, "pages").select("page_id", U.redirect_target(location, url, U.hostname_of(url)).alias("target"))


QUERIES = {
    "redirect_target": _redirects,
    "read_tables": lambda s, d: tables.read_table(s, f"{d}/pages.parquet", "page_id bigint, url string").select("page_id", "url"),
    "replace_results": _replaced,
    "norm_crawl_url": _urls(normal=U.norm_crawl_url),
    "norm_internal_link": _internal_links,
    "norm_website_url": lambda s, d: _read(s, d, "pages").select("page_id", *[f(F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("ftp"), "url")).when(F.col("page_id") % 10 == 1, F.lit(" ")).otherwise(F.concat(F.lit(" "), "url"))).alias(n) for n, f in (("website_url", U.norm_website_url), ("domain", U.website_domain), ("error", U.website_url_error))]),
    "origin_of": _urls(origin=U.origin_of),
    "extract_page_features": _features,
    "flatten_query_metrics": lambda s, d: payloads.flatten_query_metrics(_metric_payloads(s, d)),
    "flatten_metric_sites": lambda s, d: payloads.flatten_metric_sites(_site_payloads(s, d)),
    "map_listing_posts": lambda s, d: payloads.map_listing_posts(_listings(s, d)),
    "map_flat_items": _flat_items,
    "map_grounding_results": _grounding,
    "extract_answer_text": _answer_texts,
    "extract_sitemap_urls": _sitemaps,
    "parse_robots": _robots,
    "robots_sitemaps": lambda s, d: links.robots_sitemaps(_robots_files(s, d)),
    "robots_allowed": _allowed,
    "crawl_frontier": _frontier,
    "private_target_filter": _targets,
    "detect_cdn": _cdn,
    "content_link_suggestions": _suggestions,
}

_NORMAL = "regexp_replace(regexp_extract({0}, '^([^?#]*)', 1), '/+$', '') || CASE WHEN regexp_matches({0}, '^[a-z]+://[^/?#]*/*([?#]|$)') THEN '/' ELSE '' END || regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1)"
_PATH = "regexp_extract(url, '://[^/]*(/.*)', 1)"
_ALLOWED = (
    f"CASE WHEN length(host) % 3 = 0 THEN NOT starts_with({_PATH}, '/en/a') WHEN starts_with({_PATH}, '/de/t') THEN true WHEN starts_with({_PATH}, '/de/') THEN false WHEN regexp_matches({_PATH}, '^/fr/.*th') THEN false ELSE true END"
)
_KEY = "regexp_replace(regexp_extract({0}, '://([^?#]*)', 1), '/+$', '')"
#: Pages of planned topics, found by looking for every word in every page, and the links between pages.
_PLAN = search_with(
    OPP_SQL,
    PLAN_SQL,
    f"""hits AS (
      SELECT p.crawl_run_id, p.place AS t, p.topic, {_KEY.format("c.url")} AS key, min(c.page_seq) AS seq FROM plan p JOIN crawled c ON c.crawl_run_id = p.crawl_run_id
      WHERE len(list_filter(string_split_regex(lower(p.topic), '[^a-z0-9]+'), lambda w: length(w) > 3 AND (contains(lower(coalesce(c.title, '')), w) OR contains(lower(c.url), w)))) > 0 GROUP BY ALL
    ), joined AS (
      SELECT DISTINCT crawl_run_id, {_KEY.format("url")} AS source, {_KEY.format("link")} AS target FROM (SELECT crawl_run_id, url, unnest(internal_links) AS link FROM crawled WHERE contains(content_type, 'text/html') OR contains(content_type, 'application/xhtml+xml'))
    ) """,
)

ORACLE_SQL = {
    "redirect_target": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN o || CASE WHEN len(string_split(p, '/')) > 3 THEN array_to_string(string_split(p, '/')[:len(string_split(p, '/')) - 2], '/') ELSE '' END || '/up/a%20b/' WHEN 1 THEN o || '/moved/' || page_id || '/' WHEN 3 THEN o || p || '?page=2' END AS target
      FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, coalesce(nullif(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), ''), '/') AS p FROM pages)""",
    "read_tables": "SELECT page_id, url FROM pages",
    "replace_results": AUDIT_SQL["http_status_distribution"],
    "norm_crawl_url": f"SELECT page_id, {_NORMAL.format('url')} AS normal FROM pages",
    "norm_internal_link": """WITH p AS (
        SELECT page_id, page_id % 8 AS k, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o, coalesce(nullif(regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1), ''), '/') AS p,
          regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS q, regexp_matches(url, '://([^/?#]*\\.)?example\\.com([/?#]|$)') AS inside FROM pages
      ), n AS (SELECT *, coalesce(nullif(regexp_replace(p, '/+$', ''), ''), '/') AS same, string_split(p, '/') AS s FROM p)
      SELECT page_id, CASE WHEN k = 2 THEN scheme || '://www.example.com' || CASE WHEN scheme = 'http' THEN ':443' ELSE '' END || '/x?q' WHEN inside THEN CASE k WHEN 0 THEN o || CASE WHEN len(s) > 3 THEN array_to_string(s[:len(s) - 2], '/') ELSE '' END || '/up/a%20b'
        WHEN 1 THEN o || '/moved/' || page_id WHEN 3 THEN o || same || '?page=2' WHEN 5 THEN o || same || q WHEN 6 THEN o || same || q END END AS normal FROM n""",
    "norm_website_url": """SELECT page_id, CASE WHEN page_id % 10 > 1 THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') END AS website_url, CASE WHEN page_id % 10 > 1 THEN regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\\.', '') END AS domain,
      CASE page_id % 10 WHEN 0 THEN 'Website URL must use HTTP or HTTPS' WHEN 1 THEN 'Website URL is required' END AS error FROM pages""",
    "origin_of": "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages",
    "extract_page_features": "WITH "
    + HTML_SQL
    + """SELECT page_seq AS page_id, * EXCLUDE (crawl_run_id, page_id, page_seq, status_code, content_type, response_time_ms, server_header, cdn_header, internal_links), list_sort(internal_links) AS internal_links,
      NULL::VARCHAR AS twitter_title, NULL::VARCHAR AS twitter_description FROM crawled""",
    "flatten_query_metrics": f"""SELECT * EXCLUDE (odd) FROM (SELECT (doc_id // {ENTRIES})::VARCHAR AS site_url, (row_number() OVER (PARTITION BY doc_id // {ENTRIES} ORDER BY doc_id) - 1)::INTEGER AS row_ord, list_filter([source, lang], lambda k: k IS NOT NULL) AS keys, (doc_id % 50)::DOUBLE AS clicks,
      CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 900 END::DOUBLE AS impressions, 0::DOUBLE AS ctr, (doc_id % 100)::DOUBLE / 4 AS position, doc_id % 9 AS odd FROM documents) WHERE odd > 0 AND len(keys) > 0""".replace(") SELECT_ALL", ") WHERE odd > 0 AND len(keys) > 0").replace("SELECT * FROM (SELECT (doc_id", "SELECT * EXCLUDE (odd) FROM (SELECT (doc_id"),
    "flatten_metric_sites": "SELECT DISTINCT page_id % 9 AS user_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS site_url FROM pages WHERE page_id % 11 > 0",
    "map_listing_posts": f"""SELECT * FROM (SELECT (doc_id // {ENTRIES})::VARCHAR AS crawl_run_id, 'q' AS query, (row_number() OVER (PARTITION BY doc_id // {ENTRIES} ORDER BY doc_id) - 1)::INTEGER AS post_ord, 'r' || (doc_id % 7) AS subreddit, 'Post ' || doc_id AS title, '/r/' || doc_id AS permalink,
      CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'me' END AS author, CASE WHEN doc_id % 23 = 0 THEN 0 ELSE greatest(0, doc_id - 10) END::INTEGER AS score, (doc_id % 60)::INTEGER AS num_comments, make_timestamp((doc_id * 1000 + 1700000000) * 1000000) AS created_at,
      CASE WHEN doc_id % 3 = 0 OR trim(text, ' ' || chr(10)) = '' THEN NULL ELSE substr(trim(text, ' ' || chr(10)), 1, 500) END AS body_snippet FROM documents)
      WHERE split_part(permalink, '/', 3)::BIGINT % 13 <> 0 AND split_part(permalink, '/', 3)::BIGINT % 19 <> 0 AND split_part(permalink, '/', 3)::BIGINT % 11 <> 0 AND (split_part(permalink, '/', 3)::BIGINT % 4 = 0 OR split_part(permalink, '/', 3)::BIGINT % 17 <> 0)""",
    "map_flat_items": """SELECT (doc_id // 30)::VARCHAR AS crawl_run_id, (doc_id % 30)::INTEGER AS post_ord, 'Post ' || doc_id AS title, '/r/sub/' || doc_id AS permalink, (doc_id % 90)::INTEGER AS score,
      make_timestamp(CASE WHEN doc_id % 2 = 0 THEN (doc_id * 1000 + 1700000000000) * 1000 ELSE (doc_id + 1700000000) * 1000000 END) AS created_at,
      CASE WHEN doc_id % 3 = 0 AND doc_id + 2 IN (SELECT doc_id FROM documents) THEN ['body ' || (doc_id + 2)] ELSE [] END AS comments FROM documents WHERE doc_id % 3 <> 2""",
    "map_grounding_results": """SELECT * FROM (SELECT (doc_id // 30)::VARCHAR AS crawl_run_id, (doc_id % 30)::INTEGER AS post_ord, 'sub' AS subreddit, 'Post ' || doc_id AS title, '/r/sub/comments/' || (doc_id % 400) || '/' AS permalink,
      CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-02' END AS created_at, 'first' AS body_snippet, ['second'] AS comments FROM documents WHERE doc_id % 7 <> 0) QUALIFY row_number() OVER (PARTITION BY crawl_run_id ORDER BY post_ord) <= 10""",
    "extract_answer_text": r"SELECT conv_id, turn, CASE WHEN conv_id % 10 = 0 THEN '' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS answer FROM conversations",
    "extract_sitemap_urls": search_with() + "SELECT DISTINCT crawl_run_id, url || '?a=1&b=2' AS url FROM crawled",
    "robots_sitemaps": search_with() + "SELECT DISTINCT crawl_run_id AS host, unnest(CASE WHEN length(crawl_run_id) % 2 = 0 THEN ['https://x/s.xml', 'https://' || crawl_run_id || '/map.xml'] ELSE ['https://x/s.xml'] END) AS sitemap FROM crawled",
    "parse_robots": search_with()
    + """, h AS (SELECT DISTINCT crawl_run_id AS host FROM crawled), agents AS (SELECT host, 1 AS group_ord, unnest(['*', 'other']) AS agent FROM h UNION ALL SELECT host, 2, 'sitebot' FROM h WHERE length(host) % 3 = 0),
      rules AS (SELECT unnest([{'g': 1, 'rule_ord': 3, 'allow': false, 'pattern': '/de/'}, {'g': 1, 'rule_ord': 4, 'allow': true, 'pattern': '/de/t'}, {'g': 1, 'rule_ord': 6, 'allow': false, 'pattern': '/fr/*th'}, {'g': 2, 'rule_ord': 10, 'allow': false, 'pattern': '/en/a'}], recursive := true))
      SELECT host, group_ord, agent, rule_ord, allow, pattern FROM agents JOIN rules ON g = group_ord""",
    "robots_allowed": search_with() + f"SELECT host, url, {_ALLOWED} AS allowed FROM (SELECT crawl_run_id AS host, url FROM crawled)",
    "crawl_frontier": search_with("found AS (SELECT crawl_run_id, website_url || '/' AS url FROM runs UNION SELECT crawl_run_id, unnest(internal_links) FROM content)")
    + f"""SELECT crawl_run_id, place, url FROM (SELECT crawl_run_id, url, row_number() OVER (PARTITION BY crawl_run_id ORDER BY url)::INTEGER AS place FROM
      (SELECT crawl_run_id, crawl_run_id AS host, url FROM found WHERE (crawl_run_id, url) NOT IN (SELECT (crawl_run_id, url) FROM crawled WHERE page_seq % 2 = 0)) WHERE {_ALLOWED}) WHERE place <= 5""",
    "private_target_filter": """WITH t AS (SELECT event_id, event_id * 7 % 256 AS a, event_id * 3 % 256 AS b, event_id * 5 % 256 AS c, event_id % 256 AS d FROM events) SELECT event_id, CASE WHEN event_id % 50 = 1 THEN 'a' || event_id || '.example.org' ELSE a || '.' || b || '.' || c || '.' || d END AS host FROM t
      WHERE event_id % 50 = 1 OR (event_id % 50 <> 0 AND NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
        OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 224))""",
    "content_link_suggestions": _PLAN
    + r"""SELECT crawl_run_id, place, source, target, topic FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY t, i, j)::INTEGER AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY crawl_run_id, list_sort([source, target]) ORDER BY t, i, j) AS k FROM (
          SELECT a.crawl_run_id, a.t, a.topic, a.key AS source, b.key AS target, {'s': a.seq, 'k': a.key} AS i, {'s': b.seq, 'k': b.key} AS j
          FROM hits a JOIN hits b ON a.crawl_run_id = b.crawl_run_id AND a.t = b.t AND (a.seq < b.seq OR a.seq = b.seq AND a.key < b.key)
          WHERE NOT EXISTS (SELECT 1 FROM joined e WHERE e.crawl_run_id = a.crawl_run_id AND ((e.source = a.key AND e.target = b.key) OR (e.source = b.key AND e.target = a.key))))) WHERE k = 1) WHERE place <= 8""",
    "detect_cdn": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Cloudflare' WHEN page_id % 5 = 0 THEN 'Vercel' WHEN page_id % 5 = 1 THEN 'Imperva' END AS cdn FROM pages",
}
