"""Oracles of discussion terms, and the whole way from a crawl's pages to the scores of its posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..operators import discussions, opportunities
from ..sources.tables import cut_lineage, measured
from .planning_queries import AS_OF, POST_SQL, posts
from .search_queries import OPP_SQL, search_with, slug_sql, tokens_sql
from .site_tables import stored_pages


def crawl_posts(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """``posts``, dealt to the crawls of ``pages`` in turn."""
    crawls = pages.select("crawl_run_id").distinct()
    crawls = measured(crawls.withColumn("__k", F.row_number().over(Window.orderBy("crawl_run_id")) - 1), F.length("crawl_run_id") + 16)  # one row a crawl
    total = crawls.count()
    return posts(spark, sf_dir).drop("crawl_run_id").withColumn("__k", F.when(F.lit(total > 0), F.pmod("post_ord", F.lit(max(1, total)))).cast("int")).join(crawls, "__k").drop("__k")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts scored against the core terms that the pages of their own crawl have."""
    pages = stored_pages(spark, sf_dir)
    terms = discussions.noise_filter(cut_lineage(discussions.discussion_terms(pages, opportunities.rank_opportunities(pages))))
    scored = discussions.score_discussions(crawl_posts(spark, sf_dir, pages), discussions.core_discussion_terms(terms), AS_OF)
    return scored.select("crawl_run_id", "post_ord", "relevance", "impact", "confidence", "opportunity_score", "priority")


QUERIES = {"score_crawl_discussions": _scored}

_GENERAL = "[" + ", ".join(f"'{w}'" for w in discussions.GENERAL) + "]"
_CONTENT = "status_code = 200 AND (contains(content_type, 'text/html') OR contains(content_type, 'application/xhtml+xml'))"
_SPECIFIC = f"list_filter(tokens, lambda w: NOT list_contains({_GENERAL}, w))"
TERM_SQL = f"""
dfields AS (
  SELECT crawl_run_id, page_id, {slug_sql("url")} AS f, true AS dedicated, 1 AS least, {discussions.SLUG_WORDS} AS most FROM crawled
  UNION ALL SELECT crawl_run_id, page_id, CASE WHEN {_CONTENT} THEN coalesce(title, '') ELSE '' END, true, 2, {discussions.TITLE_WORDS} FROM crawled
  UNION ALL SELECT crawl_run_id, page_id, CASE WHEN {_CONTENT} THEN coalesce(meta_description, '') ELSE '' END, false, 1, 0 FROM crawled
), dtokens AS (
  SELECT *, {tokens_sql("f", 3)} AS t, lower(regexp_replace(f, '^\\s+|\\s+$', '', 'g')) AS phrase FROM dfields
), dentries AS (
  SELECT crawl_run_id, page_id, phrase AS term, t AS tokens, dedicated, {discussions.PHRASE} AS kind FROM dtokens WHERE len(t) BETWEEN least AND most AND length(phrase) <= {discussions.PHRASE_CHARS}
  UNION ALL SELECT crawl_run_id, page_id, term, [term], dedicated, {discussions.SINGLE} FROM (SELECT *, unnest(t) AS term FROM dtokens)
  UNION ALL SELECT crawl_run_id, page_id, term, string_split(term, ' '), dedicated, {discussions.BIGRAM} FROM (SELECT *, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM dtokens)
), devery AS (
  SELECT * FROM dentries WHERE length(term) >= 3
  UNION ALL SELECT crawl_run_id, NULL, lower(trim(query)), tokens, NULL, {discussions.OPPORTUNITY} FROM (SELECT *, {tokens_sql("query", 3)} AS tokens FROM ranked WHERE opportunity_type IN ('CONTENT_GAP', 'SEARCH_INTENT_GAP', 'WEAK_TOPIC_COVERAGE')) WHERE len(tokens) > 0
), dterms AS (
  SELECT crawl_run_id, term, any_value(tokens) AS tokens, count(DISTINCT page_id) AS doc_freq, coalesce(bool_or(dedicated), true) AS dedicated, max(kind)::INTEGER AS kind FROM devery GROUP BY 1, 2
), dkept AS (
  SELECT * FROM dterms d WHERE CASE WHEN kind = {discussions.SINGLE} THEN NOT list_contains({_GENERAL}, term) ELSE len({_SPECIFIC}) > 0 END
    AND NOT (kind = {discussions.BIGRAM} AND EXISTS (SELECT 1 FROM (SELECT crawl_run_id, unnest(list_transform(range(1, greatest(len(tokens), 1)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS pair FROM dterms WHERE kind = {discussions.PHRASE}) p
      WHERE p.crawl_run_id = d.crawl_run_id AND p.pair = array_to_string(d.tokens, ' ')))
), dscored AS (
  SELECT *, (20 * doc_freq + CASE WHEN dedicated THEN 10 ELSE 0 END + CASE kind WHEN {discussions.OPPORTUNITY} THEN 50 WHEN {discussions.PHRASE} THEN CASE WHEN clear THEN 30 ELSE 15 END
    WHEN {discussions.BIGRAM} THEN CASE WHEN clear THEN 25 WHEN list_contains({_GENERAL}, tokens[1]) THEN 5 ELSE 10 END ELSE CASE WHEN clear THEN 5 ELSE 0 END END) AS term_score
  FROM (SELECT *, len({_SPECIFIC}) = len(tokens) AS clear FROM dkept)
)"""
_TERMS = search_with(OPP_SQL, TERM_SQL)
#: Posts of crawls with pages, and the words of these crawls' own core terms.
_CRAWL_POSTS = POST_SQL.replace("'d' || (doc_id % 50) AS crawl_run_id", "(SELECT list(DISTINCT crawl_run_id ORDER BY crawl_run_id) FROM crawled)[1 + doc_id % (SELECT count(DISTINCT crawl_run_id) FROM crawled)] AS crawl_run_id")
_BEFORE, _, _AFTER = _CRAWL_POSTS.partition("terms AS (")
_CRAWL_POSTS = _BEFORE + f"terms AS (SELECT crawl_run_id, list(DISTINCT w) AS core FROM (SELECT crawl_run_id, unnest({tokens_sql('term')}) AS w FROM dscored WHERE doc_freq >= {R.CORE_TOPIC_PAGES}) GROUP BY 1\n), parts AS (" + _AFTER.partition("parts AS (")[2]

ORACLE_SQL = {
    "discussion_terms": _TERMS + " SELECT crawl_run_id, term, tokens, doc_freq, dedicated, kind FROM dterms",
    "noise_filter": _TERMS + " SELECT crawl_run_id, term, tokens, doc_freq, dedicated, kind FROM dkept",
    "rank_discussion_queries": _TERMS
    + f""" SELECT crawl_run_id, query_ord, term AS query, term_score, doc_freq >= {R.CORE_TOPIC_PAGES} AS core FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY term_score DESC, term)::INTEGER AS query_ord FROM dscored) WHERE query_ord <= {discussions.QUERIES_KEPT}""",
    "core_discussion_terms": _TERMS + f" SELECT crawl_run_id, term, term_score FROM dscored WHERE doc_freq >= {R.CORE_TOPIC_PAGES}",
    "score_crawl_discussions": search_with(OPP_SQL, TERM_SQL, _CRAWL_POSTS) + "SELECT crawl_run_id, post_ord, relevance, impact, confidence, opportunity_score, priority FROM pscored",
}
