"""Queries of the audit and of page statistics, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, stats
from .site_tables import CRAWL_SQL, HTML_SQL, crawl_runs, crawled_pages, html_pages


def _pages(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(crawled_pages(spark, sf_dir))


def _of_html(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The audit fed by what ``extract_page_features`` finds in the given HTML."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = html_pages(spark, sf_dir)
        return operator(pages, crawl_runs(pages))

    return query


def _both(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = crawled_pages(spark, sf_dir)
        return operator(pages, crawl_runs(pages))

    return query


QUERIES = {
    "content_page_filter": _pages(lambda p: audit.content_pages(p).select("crawl_run_id", "page_id", "url")),
    "page_issues": _pages(audit.page_issues),
    "multiple_h1_issues": _pages(audit.multiple_h1_issues),
    "site_issues": _both(lambda p, r: audit.site_issues(r)),
    "duplicate_value_issues": _pages(audit.duplicate_value_issues),
    "broken_link_issues": _pages(audit.broken_link_issues),
    "non_200_issues": _pages(audit.non_200_issues),
    "issue_counts": _both(lambda p, r: audit.issue_counts(audit.all_issues(p, r), r)),
    "crawl_state": _both(audit.crawl_state),
    **{f"dim_{k}": _both(lambda p, r, k=k: audit.dimensions(p, r).select("crawl_run_id", F.col(k).alias("score"))) for k in ("technical", "metadata", "coverage", "architecture", "content")},
    "health_score": _both(audit.health_score),
    "html_page_issues": _of_html(lambda p, r: audit.page_issues(p)),
    "html_issue_counts": _of_html(lambda p, r: audit.issue_counts(audit.all_issues(p, r), r)),
    "html_health_score": _of_html(audit.health_score),
    "html_crawl_overview": _of_html(lambda p, r: stats.crawl_overview(p)),
    "heading_stats": _pages(stats.heading_stats),
    "image_stats": _pages(stats.image_stats),
    "structured_data_stats": _pages(stats.structured_data_stats),
    "social_stats": _pages(stats.social_stats),
    "performance_stats": _pages(stats.performance_stats),
    "response_time_histogram": _pages(stats.response_time_histogram),
    "http_status_distribution": _pages(stats.http_status_distribution),
    "server_info": _pages(stats.server_info),
    "page_stats": _pages(stats.page_stats),
    "title_length_stats": _pages(stats.title_length_stats),
    "meta_length_stats": _pages(stats.meta_length_stats),
    "word_count_stats": _pages(stats.word_count_stats),
    "internal_link_stats": _pages(stats.internal_link_stats),
    "crawl_overview": _pages(stats.crawl_overview),
    "content_page_health": _pages(stats.content_page_health),
    "coverage_rates": _pages(stats.coverage_rates),
}

_PAGE_ISSUES = """
  SELECT crawl_run_id, page_id, 'MISSING_TITLE' AS issue_type, 'error' AS severity, 'Page is missing a title tag' AS message FROM content WHERE t = ''
  UNION ALL SELECT crawl_run_id, page_id, 'TITLE_TOO_SHORT', 'warning', 'Title is too short (' || length(t) || ' characters, recommended 30-60)' FROM content WHERE t <> '' AND length(t) < 30
  UNION ALL SELECT crawl_run_id, page_id, 'TITLE_TOO_LONG', 'warning', 'Title is too long (' || length(t) || ' characters, recommended 30-60)' FROM content WHERE length(t) > 60
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_META_DESCRIPTION', 'error', 'Page is missing a meta description' FROM content WHERE m = ''
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_CANONICAL', 'warning', 'Page is missing a canonical tag' FROM content WHERE coalesce(canonical_url, '') = ''
  UNION ALL SELECT crawl_run_id, page_id, 'NOINDEX_PAGE', 'warning', 'Page is set to noindex and will not be indexed' FROM content WHERE is_indexable = false
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_H1', 'error', 'Page is missing an H1 heading' FROM content WHERE h1_count = 0
  UNION ALL SELECT crawl_run_id, page_id, 'IMAGES_MISSING_ALT', 'warning', images_missing_alt || CASE WHEN images_missing_alt = 1 THEN ' image' ELSE ' images' END || ' missing alt text' FROM content WHERE images_missing_alt > 0
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_OG_TAGS', 'warning', 'Page is missing Open Graph meta tags' FROM content WHERE trim(coalesce(og_title, '')) = '' AND trim(coalesce(og_description, '')) = ''
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_VIEWPORT', 'warning', 'Page is missing a viewport meta tag for mobile rendering' FROM content WHERE NOT has_viewport
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_CHARSET', 'info', 'Page is missing a charset declaration' FROM content WHERE NOT has_charset
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_FAVICON', 'info', 'Page is missing a favicon' FROM content WHERE NOT has_favicon
  UNION ALL SELECT crawl_run_id, page_id, 'MISSING_HTML_LANG', 'info', 'Page is missing a lang attribute on the html element' FROM content WHERE coalesce(html_lang, '') = ''
  UNION ALL SELECT crawl_run_id, page_id, 'THIN_CONTENT', 'warning', 'Page has only ' || word_count || ' words (below 300 word threshold)' FROM content WHERE word_count < 300
  UNION ALL SELECT crawl_run_id, page_id, 'SLOW_RESPONSE', 'warning', 'Page responded in ' || response_time_ms || 'ms (above 3000ms threshold)' FROM content WHERE response_time_ms > 3000
"""
_H1 = "SELECT crawl_run_id, page_id, 'MULTIPLE_H1' AS issue_type, 'warning' AS severity, 'Page has ' || h1_count || ' H1 headings (should have exactly 1)' AS message FROM content WHERE h1_count > 1"
_SITE = """
  SELECT crawl_run_id, NULL::VARCHAR AS page_id, 'MISSING_HTTPS' AS issue_type, 'error' AS severity, 'Website is served over HTTP instead of HTTPS' AS message FROM runs WHERE NOT starts_with(website_url, 'https://')
  UNION ALL SELECT crawl_run_id, NULL, 'MISSING_ROBOTS_TXT', 'warning', 'No robots.txt file was found' FROM runs WHERE NOT robots_found
  UNION ALL SELECT crawl_run_id, NULL, 'MISSING_SITEMAP', 'warning', 'No XML sitemap was found' FROM runs WHERE NOT sitemap_found
"""
_DUP = """
  SELECT crawl_run_id, NULL::VARCHAR AS page_id, 'DUPLICATE_TITLE' AS issue_type, 'warning' AS severity, 'Duplicate title "' || t || '" on ' || count(*) || ' pages' AS message
  FROM content WHERE t <> '' GROUP BY crawl_run_id, t HAVING count(*) >= 2
  UNION ALL SELECT crawl_run_id, NULL, 'DUPLICATE_META_DESCRIPTION', 'warning', 'Duplicate meta description on ' || count(*) || ' pages' FROM content WHERE m <> '' GROUP BY crawl_run_id, m HAVING count(*) >= 2
"""
_LINKS = """
links AS (SELECT crawl_run_id, page_id, unnest(internal_links) AS target FROM content),
known AS (SELECT l.*, s.status_code FROM links l JOIN (SELECT crawl_run_id, url, arg_max(status_code, page_seq) AS status_code FROM crawled GROUP BY 1, 2) s ON s.crawl_run_id = l.crawl_run_id AND s.url = l.target)
"""
_BROKEN = """
  SELECT crawl_run_id, page_id, 'BROKEN_INTERNAL_LINK' AS issue_type, 'error' AS severity,
    'Broken internal link to ' || target || ' (' || CASE WHEN status_code = 0 THEN 'fetch failed' ELSE 'HTTP ' || status_code END || ')' AS message
  FROM known WHERE status_code = 0 OR status_code >= 400
"""
_NON_200 = """
  SELECT crawl_run_id, page_id, 'NON_200_PAGE' AS issue_type, CASE WHEN status_code = 0 OR status_code >= 500 THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN status_code = 0 THEN 'Page could not be fetched (no HTTP response)' ELSE 'Page returned HTTP ' || status_code END AS message
  FROM crawled WHERE status_code = 0 OR status_code >= 400
"""
_TYPES = "['MISSING_TITLE','DUPLICATE_TITLE','TITLE_TOO_SHORT','TITLE_TOO_LONG','MISSING_META_DESCRIPTION','DUPLICATE_META_DESCRIPTION','MISSING_CANONICAL','BROKEN_INTERNAL_LINK','NON_200_PAGE','NOINDEX_PAGE','MISSING_ROBOTS_TXT','MISSING_SITEMAP','MISSING_HTTPS','MISSING_H1','DUPLICATE_H1','MULTIPLE_H1','IMAGES_MISSING_ALT','MISSING_OG_TAGS','MISSING_TWITTER_TAGS','MISSING_VIEWPORT','MISSING_CHARSET','MISSING_FAVICON','MISSING_HTML_LANG','THIN_CONTENT','SLOW_RESPONSE']"
_STATE = """
state AS (
  SELECT r.crawl_run_id, CASE WHEN pages_crawled = 0 AND pages_discovered = 0 THEN 'FAILED' WHEN pages_crawled = 0 AND NOT robots_found THEN 'RESTRICTED' WHEN pages_crawled = 0 THEN 'FAILED'
    WHEN pages_crawled::DOUBLE / pages_discovered <= 0.1::DOUBLE AND pages_discovered > 10 THEN 'PARTIAL' WHEN js AND n > 0 AND w = 0 THEN 'LIMITED_RENDERING' ELSE 'COMPLETED' END AS crawl_state, pages_crawled, pages_discovered, robots_found
  FROM runs r LEFT JOIN (SELECT crawl_run_id, count(*) AS n, bool_or(js_file_count > 0) AS js, sum(coalesce(word_count, 0)) AS w FROM crawled
    WHERE contains(content_type, 'text/html') OR contains(content_type, 'application/xhtml+xml') GROUP BY 1) h ON h.crawl_run_id = r.crawl_run_id
)
"""
_DIMS = """
facts AS (
  SELECT c.crawl_run_id, count(*) AS n_pages, count(*) FILTER (status_code = 200) AS n_ok, max(r.pages_crawled) AS pc, max(r.pages_discovered) AS pd, bool_or(robots_found) AS rf, bool_or(sitemap_found) AS sf, max(website_url) AS wu, count(DISTINCT url) AS n_urls
  FROM crawled c JOIN runs r ON r.crawl_run_id = c.crawl_run_id GROUP BY 1
), cf AS (
  SELECT crawl_run_id, count(*) AS n, count(*) FILTER (is_indexable IS DISTINCT FROM false) AS indexable, count(*) FILTER (t <> '') AS titled, count(*) FILTER (length(t) BETWEEN 30 AND 60) AS good_title, count(*) FILTER (m <> '') AS meta,
    count(*) FILTER (h1_count >= 1) AS h1, count(*) FILTER (h1_count = 1) AS single_h1, count(*) FILTER (trim(coalesce(og_title, '')) <> '' OR trim(coalesce(og_description, '')) <> '') AS og, count(*) FILTER (has_viewport) AS vp,
    count(*) FILTER (has_charset) AS cs, count(*) FILTER (trim(coalesce(html_lang, '')) <> '') AS lang, count(*) FILTER (has_favicon) AS fav, count(*) FILTER (canonical_url IS NOT NULL) AS canon, count(*) FILTER (len(internal_links) > 0) AS linked,
    coalesce(sum(len(internal_links)), 0) AS links, count(*) FILTER (word_count >= 300) AS long, count(*) FILTER (response_time_ms <= 3000) AS fast, count(*) FILTER (len(json_ld_types) > 0) AS schema, count(*) FILTER (image_count = 0 OR images_missing_alt = 0) AS img
  FROM content GROUP BY 1
), lf AS (
  SELECT crawl_run_id, count(*) AS known, count(*) FILTER (status_code = 0 OR status_code >= 400) AS broken FROM known GROUP BY 1
), joined AS (
  SELECT f.*, coalesce(cf.n, 0) AS n, cf.* EXCLUDE (crawl_run_id, n), coalesce(lf.known, 0) AS known, coalesce(lf.broken, 0) AS broken FROM facts f LEFT JOIN cf ON cf.crawl_run_id = f.crawl_run_id LEFT JOIN lf ON lf.crawl_run_id = f.crawl_run_id
), scores AS (
  SELECT crawl_run_id,
    CASE WHEN starts_with(wu, 'https://') THEN 100 ELSE 0 END * 0.25::DOUBLE + (n_ok::DOUBLE / n_pages * 100) * 0.25::DOUBLE + CASE WHEN n = 0 THEN 100 ELSE (indexable::DOUBLE / n * 100) END * 0.20::DOUBLE + CASE WHEN rf THEN 100 ELSE 60 END * 0.10::DOUBLE
      + CASE WHEN sf THEN 100 ELSE 70 END * 0.10::DOUBLE + CASE WHEN n = 0 THEN 100 ELSE greatest(0, 100 - (broken * 2)::DOUBLE / (n * 5) * 100) END * 0.10::DOUBLE AS technical,
    CASE WHEN n = 0 THEN 0 ELSE (titled::DOUBLE / n * 100) * 0.15::DOUBLE + (good_title::DOUBLE / n * 100) * 0.05::DOUBLE + (meta::DOUBLE / n * 100) * 0.15::DOUBLE + (h1::DOUBLE / n * 100) * 0.10::DOUBLE + (single_h1::DOUBLE / n * 100) * 0.05::DOUBLE + (og::DOUBLE / n * 100) * 0.10::DOUBLE + (vp::DOUBLE / n * 100) * 0.10::DOUBLE + (cs::DOUBLE / n * 100) * 0.05::DOUBLE + (lang::DOUBLE / n * 100) * 0.05::DOUBLE + (fav::DOUBLE / n * 100) * 0.05::DOUBLE + (canon::DOUBLE / n * 100) * 0.15::DOUBLE END AS metadata,
    CASE WHEN pd = 0 THEN 50 ELSE (pc::DOUBLE / pd * 100) * 0.30::DOUBLE + (n_ok::DOUBLE / n_pages * 100) * 0.25::DOUBLE + CASE WHEN n = 0 THEN 0 ELSE (indexable::DOUBLE / n * 100) END * 0.20::DOUBLE + CASE WHEN n = 0 THEN 0 ELSE (canon::DOUBLE / n * 100) END * 0.15::DOUBLE
      + (100 - CASE WHEN n = 0 THEN 0 ELSE (n - indexable)::DOUBLE / n * 30 END) * 0.10::DOUBLE END AS coverage,
    CASE WHEN n = 0 THEN 0 ELSE (linked::DOUBLE / n * 100) * 0.25::DOUBLE + CASE WHEN links > 0 THEN ((links - broken)::DOUBLE / links * 100) ELSE 100 END * 0.30::DOUBLE + CASE WHEN sf THEN 100 ELSE 50 END * 0.20::DOUBLE + (known::DOUBLE / n_urls * 100) * 0.25::DOUBLE END AS architecture,
    CASE WHEN n = 0 THEN 0 ELSE (long::DOUBLE / n * 100) * 0.30::DOUBLE + (fast::DOUBLE / n * 100) * 0.30::DOUBLE + (schema::DOUBLE / n * 100) * 0.20::DOUBLE + (img::DOUBLE / n * 100) * 0.20::DOUBLE END AS content
  FROM joined
), dims AS (
  SELECT crawl_run_id, greatest(0, least(100, floor(technical + 0.5)))::INTEGER AS technical, greatest(0, least(100, floor(metadata + 0.5)))::INTEGER AS metadata, greatest(0, least(100, floor(coverage + 0.5)))::INTEGER AS coverage,
    greatest(0, least(100, floor(architecture + 0.5)))::INTEGER AS architecture, greatest(0, least(100, floor(content + 0.5)))::INTEGER AS content FROM scores
)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ", ".join([CRAWL_SQL, *parts])


_STATS = {
    "heading_stats": ", ".join(f"sum(h{k}_count)::BIGINT AS total_h{k}" for k in range(1, 7)) + ", count(*) FILTER (h1_count > 0) AS pages_with_h1, count(*) FILTER (h1_count > 1) AS pages_with_multiple_h1",
    "image_stats": "sum(image_count)::BIGINT AS total_images, sum(images_missing_alt)::BIGINT AS total_missing_alt, count(*) FILTER (image_count > 0) AS pages_with_images, count(*) FILTER (image_count = 0) AS pages_without_images",
    "structured_data_stats": "sum(len(json_ld_types))::BIGINT AS total_schema_types, coalesce(list_sort(list_distinct(flatten(list(json_ld_types)))), []) AS schema_types, count(*) FILTER (len(json_ld_types) > 0) AS pages_with_schema, count(*) FILTER (len(json_ld_types) = 0) AS pages_without_schema",
    "social_stats": "count(*) FILTER (coalesce(og_title, '') <> '' OR coalesce(og_description, '') <> '') AS pages_with_og, count(*) FILTER (twitter_card <> '') AS pages_with_twitter, count(*) FILTER (og_image <> '') AS pages_with_og_image, count(*) FILTER (twitter_image <> '') AS pages_with_twitter_image",
    "performance_stats": "round(avg(response_time_ms))::INTEGER AS avg_response_ms, max(response_time_ms) AS max_response_ms, min(response_time_ms) AS min_response_ms, round(avg(word_count))::INTEGER AS avg_words, count(*) FILTER (response_time_ms > 3000) AS slow_pages",
    "server_info": "coalesce(list_sort(list(DISTINCT server_header) FILTER (server_header <> '')), []) AS servers, coalesce(list_sort(list(DISTINCT cdn_header) FILTER (cdn_header <> '')), []) AS cdns",
    "page_stats": "count(*) AS total_pages, count(*) FILTER (status_code = 200) AS http_200, count(*) FILTER (title <> '') AS with_title, count(*) FILTER (meta_description <> '') AS with_meta, count(*) FILTER (canonical_url <> '') AS with_canonical, count(*) FILTER (has_viewport) AS with_viewport, count(*) FILTER (has_charset) AS with_charset, count(*) FILTER (has_favicon) AS with_favicon, count(*) FILTER (html_lang <> '') AS with_lang, count(*) FILTER (is_indexable IS DISTINCT FROM false) AS indexable, count(*) FILTER (is_indexable = false) AS non_indexable, count(*) FILTER (content_type LIKE '%text/html%') AS html_pages, count(*) FILTER (content_type IS NULL OR content_type NOT LIKE '%text/html%') AS non_html_pages, count(*) FILTER (word_count < 300) AS thin_content",
    "title_length_stats": "round(avg(length(title)))::INTEGER AS avg_title, min(length(title))::INTEGER AS min_title, max(length(title))::INTEGER AS max_title, count(*) FILTER (length(title) BETWEEN 1 AND 29) AS short_titles, count(*) FILTER (length(title) > 60) AS long_titles, count(*) FILTER (coalesce(title, '') = '') AS missing_titles",
    "meta_length_stats": "round(avg(length(meta_description)))::INTEGER AS avg_meta, count(*) FILTER (coalesce(meta_description, '') = '') AS missing_meta",
    "word_count_stats": "round(avg(word_count))::INTEGER AS avg_word_count, min(word_count) AS min_word_count, max(word_count) AS max_word_count, count(*) FILTER (word_count < 300) AS thin_pages, count(*) FILTER (coalesce(word_count, 0) = 0) AS zero_word_pages",
    "internal_link_stats": "round(avg(nullif(len(internal_links), 0)))::INTEGER AS avg_links, max(nullif(len(internal_links), 0))::INTEGER AS max_links, count(*) FILTER (coalesce(len(internal_links), 0) = 0) AS zero_link_pages, count(*) FILTER (len(internal_links) BETWEEN 1 AND 2) AS few_link_pages",
}
_PCT = "floor({0}::DOUBLE / {1} * 100 + 0.5)::INTEGER"

ORACLE_SQL = {
    "content_page_filter": _with() + "SELECT crawl_run_id, page_id, url FROM content",
    "page_issues": _with() + _PAGE_ISSUES,
    "multiple_h1_issues": _with() + _H1,
    "site_issues": _with() + _SITE,
    "duplicate_value_issues": _with() + _DUP,
    "broken_link_issues": _with(_LINKS) + _BROKEN,
    "non_200_issues": _with() + _NON_200,
    "issue_counts": _with(_LINKS, f"issues AS ({_PAGE_ISSUES} UNION ALL {_H1} UNION ALL {_SITE} UNION ALL {_DUP} UNION ALL {_BROKEN} UNION ALL {_NON_200})", f"every AS (SELECT crawl_run_id, unnest({_TYPES}) AS issue_type FROM runs)")
    + "SELECT e.crawl_run_id, e.issue_type, count(i.issue_type) AS issue_count FROM every e LEFT JOIN issues i ON i.crawl_run_id = e.crawl_run_id AND i.issue_type = e.issue_type GROUP BY 1, 2",
    "crawl_state": _with(_STATE)
    + """SELECT crawl_run_id, crawl_state, CASE crawl_state WHEN 'RESTRICTED' THEN 'Crawler could not access any pages. Site may be blocking crawlers.'
      WHEN 'FAILED' THEN CASE WHEN pages_discovered = 0 THEN 'No pages were discovered or crawled.' ELSE 'Pages were discovered but none could be crawled.' END
      WHEN 'PARTIAL' THEN 'Only ' || pages_crawled || ' of ' || pages_discovered || ' discovered pages were crawled (' || floor(pages_crawled::DOUBLE / pages_discovered * 100 + 0.5)::INTEGER || '% coverage).'
      WHEN 'LIMITED_RENDERING' THEN 'Pages contain JavaScript but no visible text content was extracted. Client-side rendering may be limiting crawl.' END AS reason FROM state""",
    **{f"dim_{k}": _with(_LINKS, _DIMS) + f"SELECT crawl_run_id, {k} AS score FROM dims" for k in ("technical", "metadata", "coverage", "architecture", "content")},
    "health_score": _with(_LINKS, _DIMS, _STATE)
    + """SELECT s.crawl_run_id, crawl_state, CASE WHEN dead THEN 0 ELSE technical END AS technical, CASE WHEN dead THEN 0 ELSE metadata END AS metadata, CASE WHEN dead THEN 0 ELSE coverage END AS coverage,
      CASE WHEN dead THEN 0 ELSE architecture END AS architecture, CASE WHEN dead THEN 0 ELSE content END AS content,
      CASE WHEN dead THEN 0 ELSE greatest(0, least(100, floor(technical * 0.30::DOUBLE + metadata * 0.25::DOUBLE + coverage * 0.25::DOUBLE + architecture * 0.15::DOUBLE + content * 0.05::DOUBLE + 0.5)))::INTEGER END AS health_score
      FROM (SELECT *, crawl_state IN ('FAILED', 'RESTRICTED') AS dead FROM state) s JOIN dims d ON d.crawl_run_id = s.crawl_run_id""",
    **{k: _with() + f"SELECT crawl_run_id, {v} FROM crawled GROUP BY 1" for k, v in _STATS.items()},
    "crawl_overview": _with() + f"SELECT crawl_run_id, {', '.join(_STATS.values())} FROM crawled GROUP BY 1",
    "response_time_histogram": _with(
        "b AS (SELECT crawl_run_id, CASE WHEN response_time_ms < 500 THEN 'under500' WHEN response_time_ms < 1000 THEN '500to1000' WHEN response_time_ms < 2000 THEN '1000to2000' WHEN response_time_ms < 3000 THEN '2000to3000' ELSE 'over3000' END AS bucket FROM crawled)",
        "every AS (SELECT crawl_run_id, unnest(['under500', '500to1000', '1000to2000', '2000to3000', 'over3000']) AS bucket FROM runs)",
    )
    + "SELECT e.crawl_run_id, e.bucket, count(b.bucket) AS pages FROM every e LEFT JOIN b ON b.crawl_run_id = e.crawl_run_id AND b.bucket = e.bucket GROUP BY 1, 2",
    "http_status_distribution": _with() + "SELECT crawl_run_id, status_code, count(*) AS pages FROM crawled WHERE status_code IS NOT NULL GROUP BY 1, 2",
    "content_page_health": _with(
        """h AS (SELECT crawl_run_id, count(*) AS html_pages, count(*) FILTER (coalesce(word_count, 0) < 300) AS thin, count(*) FILTER (h1_count = 1 AND h2_count >= 2) AS good_headings, count(*) FILTER (coalesce(len(internal_links), 0) = 0) AS unlinked, count(*) FILTER (title <> '') AS titled
        FROM crawled WHERE contains(content_type, 'text/html') OR contains(content_type, 'application/xhtml+xml') GROUP BY 1)"""
    )
    + "SELECT *, " + ", ".join(_PCT.format(k, "html_pages") + f" AS {k}_pct" for k in ("thin", "good_headings", "unlinked", "titled")) + " FROM h",
    "coverage_rates": _with("a AS (SELECT crawl_run_id, count(*) AS n, count(canonical_url) AS c, sum(image_count) AS i, sum(images_missing_alt) AS m FROM crawled GROUP BY 1)")
    + f"SELECT crawl_run_id, {_PCT.format('c', 'n')} AS canonical_pct, CASE WHEN i = 0 THEN 100 ELSE {_PCT.format('(i - m)', 'i')} END AS alt_pct FROM a",
}

# The same SQL over features that it reads from the HTML by itself.
ORACLE_SQL |= {f"html_{name}": ORACLE_SQL[name].replace(CRAWL_SQL, HTML_SQL) for name in ("page_issues", "issue_counts", "health_score", "crawl_overview")}
