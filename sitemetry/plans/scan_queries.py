"""Queries of metrics matching, scans, links and usage, with their oracles.

``orders`` stand for crawl runs (customer = project), ``lineitem`` for their findings and module
rows; users are customers modulo 500. Which module a line belongs to is derived and synthetic.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_query, query_tokens
from ..functions.urls import site_hostname
from ..operators import audit, links, metrics, opportunities, scans
from .audit_queries import ORACLE_SQL as AUDIT_SQL
from .search_queries import OPP_SQL, search_with
from .site_tables import crawl_runs, crawled_pages, stored_pages

AS_OF = datetime(2024, 2, 1, 12)


def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = F.expr
    return o.select(
        F.col("o_orderkey").alias("crawl_run_id"),
        F.col("o_custkey").alias("project_id"),
        e("case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end").alias("status"),
        e("cast(o_orderkey * 7 % 101 as int)").alias("health_score"),
        e("cast(o_orderkey % 50 + 10 as int)").alias("pages_discovered"),
        e("cast(o_orderkey % 40 + 5 as int)").alias("pages_crawled"),
        F.col("o_orderdate").alias("created_at"),
    )


def run_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    e = F.expr
    rows = li.select(F.col("l_orderkey").alias("crawl_run_id"), F.concat("l_returnflag", "l_linestatus").alias("issue_type"), "l_quantity", e("l_tax > 0.04").alias("mentioned"), e("l_discount > 0.05").alias("cited"), e("cast(l_partkey % 101 as int)").alias("visibility_score"))
    return {
        "issues": rows.where("l_quantity >= 20"),
        "opportunities": rows.where("l_quantity < 10"),
        "discussions": rows.where("l_quantity >= 10 and l_quantity < 20"),
        "content": rows.where("l_quantity > 40"),
        "answers": rows.where("l_quantity < 5"),
    }


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 500).alias("user_id"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_history(scans.module_counts(scan_runs(spark, sf_dir), **run_rows(spark, sf_dir)))


def query_metrics(pages: DataFrame) -> DataFrame:
    """Metrics rows from page titles: the first words as query, numbers from page_id; synthetic."""
    words = F.slice(F.split(F.lower("title"), " "), 1, 3)
    return pages.where("title is not null").select(
        "crawl_run_id",
        F.col("page_seq").alias("row_ord"),
        F.when(F.col("page_seq") % 3 == 0, F.col("title")).otherwise(F.array_join(words, " ")).alias("query"),
        (F.col("page_seq") * 7 % 50).cast("double").alias("clicks"),
        (F.col("page_seq") * 13 % 500).cast("double").alias("impressions"),
        (F.col("page_seq") % 100 / 4).alias("position"),
    )


def _matched(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = stored_pages(spark, sf_dir)
        return operator(opportunities.rank_opportunities(pages), query_metrics(pages))

    return query


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric properties of users, from pages; synthetic."""
    p = crawled_pages(spark, sf_dir)
    url = F.when(F.length("crawl_run_id") % 2 == 0, F.concat(F.lit("sc-domain:"), "crawl_run_id")).otherwise(F.concat(F.lit("https://www."), "crawl_run_id", F.lit("/")))
    return p.select((F.length("crawl_run_id") % 5).cast("bigint").alias("user_id"), url.alias("site_url")).distinct()


def _site_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = crawled_pages(spark, sf_dir).select("crawl_run_id").distinct()
    return p.select(F.col("crawl_run_id").alias("project_id"), (F.length("crawl_run_id") % 5).cast("bigint").alias("user_id"), F.concat(F.lit("www."), "crawl_run_id").alias("domain"), F.when(F.length("crawl_run_id") % 3 == 0, "set").alias("site_url"))


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sites = events.select(F.col("user_id").cast("string").alias("site_url")).distinct()
    snapshots = events.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("site_url"), (F.col("ts") + F.expr("interval 1 day 6 hours")).alias("fetched_at"))
    return metrics.snapshot_freshness(sites, snapshots, AS_OF)


def _issues(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = stored_pages(spark, sf_dir)
        return operator(audit.all_issues(pages, crawl_runs(pages)), pages)

    return query


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projects(spark, sf_dir).select("user_id").distinct().withColumn("plan", F.when(F.col("user_id") % 7 == 0, "pro").when(F.col("user_id") % 7 == 1, None).otherwise("free"))


QUERIES = {
    "normalize_query": lambda s, d: query_metrics(crawled_pages(s, d)).select("row_ord", normalize_query(F.col("query")).alias("normal")),
    "site_hostname": lambda s, d: _sites(s, d).select("user_id", "site_url", site_hostname(F.col("site_url")).alias("host")),
    "query_match_score": lambda s, d: crawled_pages(s, d).where("title is not null and meta_description is not null").select(
        "page_id", metrics.query_match_score(query_tokens(F.col("title")), query_tokens(F.col("meta_description"))).alias("match_score")
    ),
    "match_queries": _matched(lambda o, m: metrics.match_queries(o, m).join(o.select("crawl_run_id", "opportunity_id", "rank"), ["crawl_run_id", "opportunity_id"]).select("crawl_run_id", "row_ord", "rank", "match_score")),
    "enrich_opportunities": _matched(lambda o, m: metrics.enrich_opportunities(o, m).select("crawl_run_id", "rank", "clicks", "impressions", "ctr", "position", "queries")),
    "metrics_summary": _matched(metrics.metrics_summary),
    "link_sites": lambda s, d: metrics.link_sites(_site_projects(s, d), _sites(s, d)),
    "snapshot_freshness": _freshness,
    "link_graph": lambda s, d: links.link_graph(crawled_pages(s, d)),
    "discovered_urls": lambda s, d: links.discovered_urls(crawled_pages(s, d), crawl_runs(crawled_pages(s, d))),
    "affected_pages": _issues(scans.affected_pages),
    "remediation_groups": _issues(scans.remediation_groups),
    "issues_by_severity": _issues(lambda i, p: scans.issues_by_severity(i)),
    "scan_history": _history,
    "scan_comparison": lambda s, d: scans.scan_comparison(_history(s, d)),
    "issue_type_deltas": lambda s, d: scans.issue_type_deltas(_history(s, d), run_rows(s, d)["issues"]),
    "improvements_regressions": lambda s, d: scans.improvements_regressions(scans.scan_comparison(_history(s, d))),
    "latest_scan_per_project": lambda s, d: scans.latest_scan_per_project(projects(s, d), scan_runs(s, d)),
    "scan_counts_by_user": lambda s, d: scans.scan_counts_by_user(projects(s, d), scan_runs(s, d)),
    "scan_entitlement": lambda s, d: scans.scan_entitlement(_users(s, d), projects(s, d), scan_runs(s, d)),
}

_QT = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"
METRIC_SQL = """
metric AS (
  SELECT crawl_run_id, page_seq AS row_ord, CASE WHEN page_seq % 3 = 0 THEN title ELSE array_to_string(string_split(lower(title), ' ')[1:3], ' ') END AS query,
    (page_seq * 7 % 50)::DOUBLE AS clicks, (page_seq * 13 % 500)::DOUBLE AS impressions, (page_seq % 100)::DOUBLE / 4 AS position FROM crawled WHERE title IS NOT NULL
)"""


def _score_sql(a: str, b: str) -> str:
    inside = f"len(list_filter({a}, lambda x: list_contains({b}, x)))"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 WHEN {a} = {b} THEN 1 WHEN {inside} = len({a}) THEN 0.8 WHEN list_has_all({a}, {b}) THEN 0.7"
        f" ELSE {inside}::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END::DOUBLE"
    )


#: By comparing all pairs of a crawl, unlike the query's join on tokens.
MATCH_SQL = f"""
{METRIC_SQL}, scored_pairs AS (
  SELECT o.crawl_run_id, o.rank, o.score, o.opportunity_id, m.row_ord, {_score_sql("o.a", "m.b")} AS match_score
  FROM (SELECT *, {_QT.format("query")} AS a FROM ranked) o JOIN (SELECT *, {_QT.format("query")} AS b FROM metric) m ON m.crawl_run_id = o.crawl_run_id
), matched AS (
  SELECT crawl_run_id, row_ord, rank, match_score FROM scored_pairs WHERE match_score >= 0.6 QUALIFY row_number() OVER (PARTITION BY crawl_run_id, row_ord ORDER BY match_score DESC, score, opportunity_id) = 1
)"""
SCAN_SQL = """
WITH runs AS (
  SELECT o_orderkey AS crawl_run_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, (o_orderkey * 7 % 101)::INTEGER AS health_score,
    (o_orderkey % 50 + 10)::INTEGER AS pages_discovered, (o_orderkey % 40 + 5)::INTEGER AS pages_crawled, o_orderdate AS created_at FROM orders
), li AS (
  SELECT l_orderkey AS crawl_run_id, l_returnflag || l_linestatus AS issue_type, l_quantity AS q, l_tax > 0.04::DOUBLE AS mentioned, l_discount > 0.05::DOUBLE AS cited, (l_partkey % 101)::INTEGER AS vs FROM lineitem
), history AS (
  SELECT r.*, coalesce(n.issue_count, 0) AS issue_count, coalesce(n.opportunities, 0) AS opportunities, coalesce(n.discussions, 0) AS discussions, coalesce(n.content, 0) AS content, ai_total, ai_mentioned, ai_cited, ai_score,
    row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, r.crawl_run_id DESC)::INTEGER AS scan_rank
  FROM runs r LEFT JOIN (SELECT crawl_run_id, count(*) FILTER (q >= 20) AS issue_count, count(*) FILTER (q < 10) AS opportunities, count(*) FILTER (q >= 10 AND q < 20) AS discussions, count(*) FILTER (q > 40) AS content,
      nullif(count(*) FILTER (q < 5), 0) AS ai_total, CASE WHEN count(*) FILTER (q < 5) > 0 THEN count(*) FILTER (q < 5 AND mentioned) END AS ai_mentioned, CASE WHEN count(*) FILTER (q < 5) > 0 THEN count(*) FILTER (q < 5 AND cited) END AS ai_cited,
      floor(avg(vs) FILTER (q < 5) + 0.5)::INTEGER AS ai_score FROM li GROUP BY 1) n ON n.crawl_run_id = r.crawl_run_id
  WHERE status = 'COMPLETED'
), comparison AS (
  SELECT c.project_id, c.crawl_run_id, p.crawl_run_id AS previous_run, c.health_score, p.health_score AS previous_health_score, c.health_score - p.health_score AS health_score_delta, c.pages_discovered, p.pages_discovered AS previous_pages_discovered,
    c.pages_discovered - p.pages_discovered AS pages_discovered_delta, c.pages_crawled, p.pages_crawled AS previous_pages_crawled, c.pages_crawled - p.pages_crawled AS pages_crawled_delta, c.issue_count, p.issue_count AS previous_issue_count,
    c.issue_count - p.issue_count AS issue_count_delta, CASE WHEN c.opportunities > 0 AND p.opportunities > 0 THEN c.opportunities - p.opportunities END AS opportunities_delta,
    CASE WHEN c.discussions > 0 AND p.discussions > 0 THEN c.discussions - p.discussions END AS discussions_delta, CASE WHEN c.content > 0 AND p.content > 0 THEN c.content - p.content END AS content_delta,
    c.ai_score - p.ai_score AS ai_score_delta, c.ai_mentioned - p.ai_mentioned AS ai_mentioned_delta, c.ai_cited - p.ai_cited AS ai_cited_delta
  FROM history c LEFT JOIN history p ON p.project_id = c.project_id AND p.scan_rank = 2 WHERE c.scan_rank = 1
), projects AS (SELECT c_custkey AS project_id, c_custkey % 500 AS user_id FROM customer
), counts AS (SELECT user_id, count(*) AS scans, count(*) FILTER (status = 'COMPLETED') AS completed FROM projects JOIN runs USING (project_id) GROUP BY 1)
"""
_SENTENCES = [
    ("improvement", "health_score_delta > 0", "'Health score improved +' || health_score_delta || ' (' || previous_health_score || ' → ' || health_score || ').'"),
    ("regression", "health_score_delta < 0", "'Health score declined ' || health_score_delta || ' (' || previous_health_score || ' → ' || health_score || ').'"),
    ("improvement", "issue_count_delta < 0", "'Technical issues reduced by ' || -issue_count_delta || ' (' || previous_issue_count || ' → ' || issue_count || ').'"),
    ("regression", "issue_count_delta > 0", "'Technical issues increased by +' || issue_count_delta || ' (' || previous_issue_count || ' → ' || issue_count || ').'"),
    ("improvement", "pages_crawled_delta > 0", "'Crawl coverage grew from ' || previous_pages_crawled || ' to ' || pages_crawled || ' pages.'"),
    ("regression", "pages_crawled_delta < 0", "'Crawl coverage shrank from ' || previous_pages_crawled || ' to ' || pages_crawled || ' pages.'"),
    ("improvement", "opportunities_delta > 0", "'+' || opportunities_delta || ' more search opportunities identified.'"),
    ("regression", "opportunities_delta < 0", "-opportunities_delta || ' fewer search opportunities identified.'"),
    ("improvement", "content_delta > 0", "'+' || content_delta || ' more content recommendations generated.'"),
    ("regression", "content_delta < 0", "-content_delta || ' fewer content recommendations generated.'"),
    ("improvement", "ai_score_delta > 0", "'AI visibility score improved +' || ai_score_delta || '.'"),
    ("regression", "ai_score_delta < 0", "'AI visibility score declined ' || ai_score_delta || '.'"),
    ("improvement", "ai_cited_delta > 0", "'+' || ai_cited_delta || ' more AI citations detected.'"),
    ("regression", "ai_cited_delta < 0", "-ai_cited_delta || ' fewer AI citations detected.'"),
]
_SITES = "sites AS (SELECT DISTINCT (length(crawl_run_id) % 5)::BIGINT AS user_id, CASE WHEN length(crawl_run_id) % 2 = 0 THEN 'sc-domain:' || crawl_run_id ELSE 'https://www.' || crawl_run_id || '/' END AS site_url, CASE WHEN length(crawl_run_id) % 2 = 0 THEN regexp_replace(crawl_run_id, '^www\\.', '') ELSE crawl_run_id END AS host FROM crawled)"
_ISSUES = "issues AS (" + AUDIT_SQL["issue_counts"].split("issues AS (", 1)[1].split("), every AS", 1)[0] + ")"
_LINKS = AUDIT_SQL["broken_link_issues"].split("links AS (", 1)[1].split("SELECT crawl_run_id, page_id, 'BROKEN_INTERNAL_LINK'", 1)[0]
_KEY = "regexp_extract({0}, '://([^/?#]*)', 1) || regexp_replace(regexp_extract({0}, '://[^/?#]*(/[^?#]*)', 1), '/+$', '')"
ISSUE_SQL = search_with("links AS (" + _LINKS.strip(), _ISSUES)

ORACLE_SQL = {
    "normalize_query": search_with(METRIC_SQL) + "SELECT row_ord, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS normal FROM metric",
    "site_hostname": search_with(_SITES) + "SELECT user_id, site_url, host FROM sites",
    "query_match_score": search_with(f"p AS (SELECT page_id, {_QT.format('title')} AS a, {_QT.format('meta_description')} AS b FROM crawled WHERE title IS NOT NULL AND meta_description IS NOT NULL)") + f"SELECT page_id, {_score_sql('a', 'b')} AS match_score FROM p",
    "match_queries": search_with(OPP_SQL, MATCH_SQL) + "SELECT * FROM matched",
    "enrich_opportunities": search_with(OPP_SQL, MATCH_SQL)
    + """SELECT r.crawl_run_id, r.rank, e.* EXCLUDE (crawl_run_id, rank) FROM ranked r LEFT JOIN (
      SELECT m.crawl_run_id, m.rank, sum(clicks) AS clicks, sum(impressions) AS impressions, CASE WHEN sum(impressions) > 0 THEN floor(sum(clicks) / sum(impressions) * 10000 + 0.5) / 10000 ELSE 0 END AS ctr,
        CASE WHEN sum(impressions) > 0 THEN floor(sum(position * impressions) / sum(impressions) * 10 + 0.5) / 10 ELSE 0 END AS position, list(query ORDER BY impressions DESC, clicks DESC, m.row_ord)[1:25] AS queries
      FROM matched m JOIN metric USING (crawl_run_id, row_ord) GROUP BY 1, 2) e ON e.crawl_run_id = r.crawl_run_id AND e.rank = r.rank""",
    "metrics_summary": search_with(OPP_SQL, MATCH_SQL) + "SELECT m.crawl_run_id, count(*) AS queries_fetched, count(x.row_ord) AS queries_matched FROM metric m LEFT JOIN matched x ON x.crawl_run_id = m.crawl_run_id AND x.row_ord = m.row_ord GROUP BY 1",
    "link_sites": search_with(_SITES) + "SELECT c.crawl_run_id AS project_id, s.user_id, max(s.site_url) AS site_url FROM (SELECT DISTINCT crawl_run_id FROM crawled WHERE length(crawl_run_id) % 3 <> 0) c JOIN sites s ON s.user_id = length(c.crawl_run_id) % 5 AND s.host = c.crawl_run_id GROUP BY 1, 2",
    "snapshot_freshness": """SELECT user_id::VARCHAR AS site_url, coalesce(max(ts) FILTER (event_type = 'purchase') + INTERVAL 30 HOUR, TIMESTAMP '1970-01-01') < TIMESTAMP '2024-02-01 06:00:00' AS stale, DATE '2024-01-05' AS start_date, DATE '2024-02-01' AS end_date
      FROM events GROUP BY 1""",
    "link_graph": search_with(f"edges AS (SELECT DISTINCT crawl_run_id, {_KEY.format('url')} AS source, {_KEY.format('target')} AS target FROM (SELECT crawl_run_id, url, unnest(internal_links) AS target FROM crawled WHERE contains(content_type, 'text/html') OR contains(content_type, 'application/xhtml+xml')))") + "SELECT * FROM edges",
    "discovered_urls": search_with() + "SELECT crawl_run_id, website_url || '/' AS url FROM runs UNION SELECT crawl_run_id, unnest(internal_links) FROM content",
    "affected_pages": ISSUE_SQL
    + """SELECT t.crawl_run_id, place, url, issues, errors, warnings FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY issues DESC, page_id)::INTEGER AS place FROM (
      SELECT crawl_run_id, page_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues WHERE page_id IS NOT NULL GROUP BY 1, 2)) t JOIN crawled USING (crawl_run_id, page_id) WHERE place <= 15""",
    "remediation_groups": ISSUE_SQL
    + """SELECT i.crawl_run_id, issue_type, count(*) AS issues, count(DISTINCT regexp_replace(url, '^https?://[^/]+', '')) AS affected_paths, CASE min(severity) WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS tier
      FROM issues i LEFT JOIN crawled c ON c.crawl_run_id = i.crawl_run_id AND c.page_id = i.page_id GROUP BY 1, 2""",
    "issues_by_severity": ISSUE_SQL
    + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, issue_type, page_id NULLS FIRST, message)::INTEGER AS place FROM issues) WHERE place <= 10""",
    "scan_history": SCAN_SQL + "SELECT * FROM history",
    "scan_comparison": SCAN_SQL + "SELECT * FROM comparison",
    "issue_type_deltas": SCAN_SQL
    + """SELECT h.project_id, issue_type, count(*) FILTER (scan_rank = 2) AS issues_from, count(*) FILTER (scan_rank = 1) AS issues_to, count(*) FILTER (scan_rank = 1) - count(*) FILTER (scan_rank = 2) AS issues_delta
      FROM history h JOIN li ON li.crawl_run_id = h.crawl_run_id AND q >= 20 WHERE scan_rank <= 2 AND project_id IN (SELECT project_id FROM history WHERE scan_rank = 2) GROUP BY 1, 2""",
    "improvements_regressions": SCAN_SQL + " UNION ALL ".join(f"SELECT project_id, '{k}' AS kind, {s} AS sentence FROM comparison WHERE {w}" for k, w, s in _SENTENCES),
    "latest_scan_per_project": SCAN_SQL
    + """SELECT p.project_id, count(r.crawl_run_id) AS scan_count, arg_max(r.crawl_run_id, (created_at, r.crawl_run_id)) AS latest_crawl_run_id, arg_max(status, (created_at, r.crawl_run_id)) AS latest_status,
      arg_max(health_score, (created_at, r.crawl_run_id)) AS latest_health_score, arg_max(pages_crawled, (created_at, r.crawl_run_id)) AS latest_pages_crawled FROM projects p LEFT JOIN runs r ON r.project_id = p.project_id GROUP BY 1""",
    "scan_counts_by_user": SCAN_SQL + "SELECT * FROM counts",
    "scan_entitlement": SCAN_SQL
    + """SELECT u.user_id, CASE WHEN u.user_id % 7 = 0 THEN 'pro' ELSE 'free' END AS plan, u.user_id % 7 = 0 OR coalesce(completed, 0) = 0 AS can_scan FROM (SELECT DISTINCT user_id FROM projects) u LEFT JOIN counts c ON c.user_id = u.user_id""",
}
