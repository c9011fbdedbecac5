"""Queries of topics and search opportunities, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import STOPWORDS, significant_tokens, term_candidates
from ..functions.urls import is_utility_page, slug_phrase
from ..operators import opportunities as O
from ..operators import topics as T
from .site_tables import CRAWL_SQL, crawled_pages


def crawl_plans(pages: DataFrame) -> DataFrame:
    """A plan for every crawl, by the length of its host; synthetic."""
    return pages.select("crawl_run_id").distinct().withColumn("plan", F.when(F.length("crawl_run_id") % 2 == 0, "pro").otherwise("free"))


def _q(operator):
    return lambda spark, sf_dir: operator(crawled_pages(spark, sf_dir))


def _topics(operator):
    return _q(lambda p: operator(T.extract_topics(T.topic_pages(T.page_profiles(p)))))


def _kind(name: str):
    columns = ["crawl_run_id", "query", "opportunity_type", "relevance", "impact", "confidence", "score", "priority", "coverage", "reason", "related_page_id"]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind, _, only = name.partition(":")
        rows = O.all_candidates(crawled_pages(spark, sf_dir))[kind]
        return (rows.where(F.col("opportunity_type") == only) if only else rows).select(*columns)

    return query


def _best(pages: DataFrame) -> DataFrame:
    profiles = T.page_profiles(pages)
    return T.best_topics(profiles, T.core_topics(T.extract_topics(T.topic_pages(profiles))))


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = crawled_pages(spark, sf_dir)
    rows = pages.where("title is not null").join(T.site_brands(pages), "crawl_run_id", "left")
    return rows.select("crawl_run_id", "page_id", R.classify_intent(F.col("title"), F.col("brand")).alias("intent"))


RANKED = ["crawl_run_id", "rank", "query", "opportunity_type", "score", "priority", "intent", "reason", "related_page_url"]

QUERIES = {
    "slug_phrase": _q(lambda p: p.select("page_id", slug_phrase(F.col("url")).alias("slug"))),
    "significant_tokens": _q(lambda p: p.select("page_id", significant_tokens(F.col("title")).alias("tokens"))),
    "term_candidates": _q(lambda p: p.select("page_id", term_candidates(significant_tokens(F.col("title"))).alias("terms"))),
    "is_utility_page": _q(lambda p: p.select("page_id", is_utility_page(F.regexp_replace("url", "/(de|fr)/", "/about/")).alias("utility"))),
    "classify_intent": _intents,
    "site_brand": _q(T.site_brands),
    "page_profiles": _q(lambda p: T.page_profiles(p).select("crawl_run_id", "page_id", "p_title", "p_meta", "p_slug", "title_tokens", "meta_tokens", "slug_tokens", F.array_sort("all_tokens").alias("all_tokens"))),
    "extract_topics": _topics(lambda t: t),
    "topics_analyzed": _topics(T.topics_analyzed),
    "core_topics": _topics(T.core_topics),
    "ai_prompt_topics": _topics(T.ai_prompt_topics),
    "best_topic_for_page": _q(_best),
    "content_gap": _kind("topics:CONTENT_GAP"),
    "weak_topic_coverage": _kind("topics:WEAK_TOPIC_COVERAGE"),
    "page_optimization": _kind("page_optimization"),
    "search_intent_gap": _kind("search_intent_gap"),
    "orphan_pages": _kind("orphan_pages"),
    "unlinked_topic_pairs": _kind("unlinked_topic_pairs"),
    "score_opportunity": lambda spark, sf_dir: O.all_candidates(crawled_pages(spark, sf_dir))["orphan_pages"].select("crawl_run_id", "related_page_id", "score", "priority"),
    "evidence": lambda spark, sf_dir: O.all_candidates(crawled_pages(spark, sf_dir))["topics"].select("crawl_run_id", "query", F.col("evidence_pages.id").alias("page_ids"), "evidence_phrases"),
    "rank_opportunities": _q(lambda p: O.rank_opportunities(p).select(*RANKED)),
    "opportunity_aggregate": _q(lambda p: O.opportunity_aggregate(O.rank_opportunities(p))),
    "entitled_top_k": _q(lambda p: O.entitled_top_k(O.rank_opportunities(p), crawl_plans(p)).select("crawl_run_id", "query", "opportunity_type", "score", "related_page_url")),
    "action_roadmap": _q(lambda p: O.action_roadmap(O.rank_opportunities(p))),
}

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_sql(value: str, least: int = 4) -> str:
    words = rf"string_split(trim(regexp_replace(regexp_replace(lower(coalesce({value}, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' ')"
    return f"list_filter({words}, lambda w: length(w) >= {least} AND NOT regexp_matches(w, '^[0-9]+$') AND NOT list_contains({_STOP}, w))"


def slug_sql(url: str) -> str:
    path = f"coalesce(nullif(regexp_extract({url}, '://[^/?#]*(/[^?#]*)', 1), ''), '/')"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({path}, '[_-]+', ' ', 'g'), '[^A-Za-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def terms_sql(words: str) -> str:
    return f"list_concat({words}, list_transform(range(1, greatest(len({words}), 1)), lambda i: {words}[i] || ' ' || {words}[i + 1]))"


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def intent_sql(query: str, brand: str) -> str:
    words = f"string_split_regex(lower(trim({query})), '[^a-z0-9]+')"
    return (
        f"CASE WHEN length(regexp_replace(lower(trim({query})), '[^a-z0-9]', '', 'g')) >= 4 AND regexp_replace(lower(trim({query})), '[^a-z0-9]', '', 'g') = regexp_replace({brand}, '[^a-z0-9]', '', 'g') THEN 'navigational'"
        f" WHEN list_has_any({words}, {_words(R.COMMERCIAL_WORDS)}) OR contains(lower({query}), 'for beginners') THEN 'commercial' WHEN list_has_any({words}, {_words(R.TRANSACTIONAL_WORDS)}) THEN 'transactional' ELSE 'informational' END"
    )


def priority_sql(score: str) -> str:
    return f"CASE WHEN {score} >= 70 THEN 'high' WHEN {score} >= 40 THEN 'medium' ELSE 'low' END"


TOPIC_SQL = f"""
profiles0 AS (SELECT *, {slug_sql("url")} AS slug FROM content),
profiles AS (SELECT *, {tokens_sql("t")} AS tt, {tokens_sql("m")} AS mt, {tokens_sql("slug")} AS st FROM profiles0),
topic_page AS (
  SELECT crawl_run_id, term, page_id, min(page_seq) AS page_seq, bool_or(ded) AS dedicated FROM (
    SELECT crawl_run_id, page_id, page_seq, unnest({terms_sql("tt")}) AS term, true AS ded FROM profiles
    UNION ALL SELECT crawl_run_id, page_id, page_seq, unnest({terms_sql("mt")}), false FROM profiles
    UNION ALL SELECT crawl_run_id, page_id, page_seq, unnest({terms_sql("st")}), true FROM profiles) GROUP BY 1, 2, 3
), topics AS (
  SELECT crawl_run_id, term, count(*) AS doc_freq, count(*) FILTER (dedicated) AS dedicated_pages, contains(term, ' ') AS is_bigram FROM topic_page GROUP BY 1, 2
), core AS (
  SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY doc_freq DESC, term)::INTEGER AS topic_rank FROM topics WHERE doc_freq >= 2
), best AS (
  -- by containment of all of the topic's words, unlike the query's join on single words
  SELECT crawl_run_id, page_id, term AS best_term, doc_freq AS best_freq FROM (
    SELECT p.crawl_run_id, p.page_id, c.term, c.doc_freq, row_number() OVER (PARTITION BY p.crawl_run_id, p.page_id ORDER BY c.topic_rank) AS k
    FROM profiles p JOIN core c ON c.crawl_run_id = p.crawl_run_id AND list_has_all(list_concat(tt, mt, st), string_split(c.term, ' '))) WHERE k = 1
), brands AS (
  SELECT crawl_run_id, arg_min(regexp_extract(regexp_replace(regexp_extract(url, '://([^/]*)', 1), '^www\\.', ''), '^([^.]*)', 1), page_seq) AS brand FROM content GROUP BY 1
)
"""

OPP_SQL = f"""
rowsp AS (
  SELECT p.*, b.best_term, b.best_freq, list_filter(st, lambda x: NOT list_contains(tt, x) AND NOT list_contains(mt, x))[1] AS missing, coalesce(word_count, 0) AS w, least(40, 5 * least(coalesce(best_freq, 1), 8)) AS rel,
    least(30, 16 + CASE WHEN is_indexable = false THEN 0 ELSE 4 END + CASE WHEN canonical_url IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN t <> '' THEN 3 ELSE 0 END + CASE WHEN m <> '' THEN 3 ELSE 0 END) AS conf,
    CASE WHEN slug <> '' THEN slug ELSE url END AS su, list_filter({_words(R.INTENT_MODIFIERS)}, lambda x: contains(lower(t), x))[1] AS modifier
  FROM profiles p LEFT JOIN best b ON b.crawl_run_id = p.crawl_run_id AND b.page_id = p.page_id
), cover AS (
  SELECT tp.crawl_run_id, tp.term, tp.page_id, tp.page_seq, tp.dedicated, c.doc_freq, c.dedicated_pages, c.topic_rank, r.w, r.url FROM topic_page tp JOIN core c ON c.crawl_run_id = tp.crawl_run_id AND c.term = tp.term JOIN rowsp r ON r.crawl_run_id = tp.crawl_run_id AND r.page_id = tp.page_id
), tfacts AS (
  SELECT crawl_run_id, term, doc_freq, dedicated_pages, topic_rank, sum(w) AS total, count(*) FILTER (dedicated AND w < 300) AS thin,
    list(page_id ORDER BY w DESC, page_seq) AS by_words, list(page_id ORDER BY w DESC, page_seq) FILTER (dedicated) AS own_by_words, list(page_id ORDER BY page_seq) FILTER (dedicated) AS own
  FROM cover GROUP BY 1, 2, 3, 4, 5
), gap AS (
  SELECT crawl_run_id, term AS query, 'CONTENT_GAP' AS opportunity_type, least(40, 5 * least(doc_freq, 8)) AS relevance, 30 AS impact, least(30, 10 + 4 * doc_freq) AS confidence,
    'The site references "' || term || '" on ' || doc_freq || ' page(s) but no page targets it directly.' AS reason, by_words[1] AS related_page_id, 1 AS phase, topic_rank AS seq, 0 AS sub, by_words[1:5] AS page_ids FROM tfacts WHERE dedicated_pages = 0
), weak AS (
  SELECT crawl_run_id, term AS query, 'WEAK_TOPIC_COVERAGE' AS opportunity_type, least(40, 5 * least(doc_freq, 8)) AS relevance, greatest(5, 30 - total // 50) AS impact, least(30, 10 + 3 * doc_freq + 2 * dedicated_pages) AS confidence,
    '"' || term || '" is covered by only ' || total || ' words across ' || dedicated_pages || ' page(s).' AS reason, own_by_words[1] AS related_page_id, 1 AS phase, topic_rank AS seq, 0 AS sub, own[1:5] AS page_ids FROM tfacts WHERE dedicated_pages > 0 AND (total < 800 OR thin > 0)
), opt0 AS (
  SELECT crawl_run_id, coalesce(best_term, su) AS query, rel AS relevance, 18 + CASE WHEN missing IS NULL THEN 0 ELSE 4 END AS impact, conf AS confidence, url || ' has no title tag.' AS reason, page_id, page_seq, 0 AS sub FROM rowsp WHERE t = ''
  UNION ALL SELECT crawl_run_id, coalesce(best_term, t), rel, 18, conf, 'The title of ' || url || ' is ' || length(t) || ' characters (recommended 30-60).', page_id, page_seq, 1 FROM rowsp WHERE t <> '' AND NOT length(t) BETWEEN 30 AND 60
  UNION ALL SELECT crawl_run_id, coalesce(best_term, nullif(t, ''), url), rel, 16, conf, url || ' is missing a meta description.', page_id, page_seq, 2 FROM rowsp WHERE m = ''
  UNION ALL SELECT crawl_run_id, coalesce(best_term, t), rel, 14, conf, 'The meta description of ' || url || ' is only ' || length(m) || ' characters (recommended at least 50).', page_id, page_seq, 3 FROM rowsp WHERE m <> '' AND length(m) < 50
  UNION ALL SELECT crawl_run_id, coalesce(best_term, missing), rel, 14, conf, 'The URL of ' || url || ' targets "' || missing || '" but the title and meta description do not mention it.', page_id, page_seq, 4 FROM rowsp WHERE missing IS NOT NULL
), opt AS (
  SELECT crawl_run_id, query, 'EXISTING_PAGE_OPTIMIZATION' AS opportunity_type, relevance, impact, confidence, reason, page_id AS related_page_id, 2 AS phase, page_seq AS seq, sub FROM opt0 QUALIFY row_number() OVER (PARTITION BY crawl_run_id, page_id ORDER BY sub) <= 2
), intentgap AS (
  SELECT crawl_run_id, t AS query, 'SEARCH_INTENT_GAP' AS opportunity_type, CASE WHEN best_term IS NULL THEN 8 ELSE rel END AS relevance, 12 + CASE WHEN w < 200 THEN 10 ELSE 6 END + CASE WHEN m = '' THEN 4 ELSE 0 END AS impact,
    least(30, 16 + coalesce(3 * best_freq, 3)) AS confidence, '"' || t || '" suggests an informational intent ("' || modifier || '") but the page is thin (' || w || ' words' || CASE WHEN m = '' THEN ' and has no meta description' ELSE '' END || ').' AS reason,
    page_id AS related_page_id, 3 AS phase, page_seq AS seq, 0 AS sub FROM rowsp WHERE t <> '' AND modifier IS NOT NULL AND (w < 400 OR m = '')
), linked AS (SELECT DISTINCT crawl_run_id, unnest(internal_links) AS url FROM content
), orphan AS (
  SELECT r.crawl_run_id, coalesce(best_term, su) AS query, 'INTERNAL_LINK_OPPORTUNITY' AS opportunity_type, rel AS relevance, 22 AS impact, least(30, 20 + CASE WHEN best_freq IS NULL THEN 0 ELSE 4 * least(best_freq, 4) END) AS confidence,
    url || ' is not linked from any other page on the site.' AS reason, page_id AS related_page_id, 4 AS phase, page_seq AS seq, 0 AS sub
  FROM rowsp r ANTI JOIN linked l ON l.crawl_run_id = r.crawl_run_id AND l.url = r.url WHERE (SELECT count(*) FROM content c WHERE c.crawl_run_id = r.crawl_run_id) > 1
), pairs AS (
  SELECT a.crawl_run_id, a.term, a.doc_freq, a.topic_rank, a.page_id AS pa, b.page_id AS pb, a.url AS ua, b.url AS ub, row_number() OVER (PARTITION BY a.crawl_run_id ORDER BY a.topic_rank, a.page_seq, b.page_seq) AS k
  FROM cover a JOIN cover b ON a.crawl_run_id = b.crawl_run_id AND a.term = b.term AND a.page_seq < b.page_seq AND a.dedicated AND b.dedicated
  JOIN content x ON x.crawl_run_id = a.crawl_run_id AND x.page_id = a.page_id JOIN content y ON y.crawl_run_id = b.crawl_run_id AND y.page_id = b.page_id
  WHERE NOT coalesce(list_contains(x.internal_links, y.url), false) AND NOT coalesce(list_contains(y.internal_links, x.url), false)
), pair AS (
  SELECT crawl_run_id, term AS query, 'INTERNAL_LINK_OPPORTUNITY' AS opportunity_type, least(40, 5 * least(doc_freq, 8)) AS relevance, 16 + CASE WHEN doc_freq >= 3 THEN 4 ELSE 0 END AS impact, least(30, 12 + 4 * least(doc_freq, 4)) AS confidence,
    ua || ' and ' || ub || ' both cover "' || term || '" but do not link to each other.' AS reason, pa AS related_page_id, 5 AS phase, k AS seq, 0 AS sub FROM pairs WHERE k <= 2
), cand AS (
  SELECT crawl_run_id, query, opportunity_type, relevance::INTEGER AS relevance, impact::INTEGER AS impact, confidence::INTEGER AS confidence, reason, related_page_id, phase, seq, sub FROM
  (SELECT * EXCLUDE (page_ids) FROM gap UNION ALL SELECT * EXCLUDE (page_ids) FROM weak UNION ALL SELECT * FROM opt UNION ALL SELECT * FROM intentgap UNION ALL SELECT * FROM orphan UNION ALL SELECT * FROM pair)
), cands AS (
  SELECT c.*, relevance + impact + confidence AS score, {priority_sql("(relevance + impact + confidence)")} AS priority, CASE WHEN opportunity_type = 'CONTENT_GAP' THEN 'GAP' ELSE 'IMPROVEMENT' END AS coverage, p.url AS related_page_url
  FROM cand c JOIN content p ON p.crawl_run_id = c.crawl_run_id AND p.page_id = c.related_page_id
), uniq AS (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY crawl_run_id, opportunity_type, lower(query), related_page_url, reason ORDER BY phase, seq, sub) = 1
), capped AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY crawl_run_id, opportunity_type ORDER BY phase, seq, sub) <= 4
), ranked0 AS (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY score DESC, query, phase, seq, sub)::INTEGER AS rank FROM capped
), ranked AS (
  SELECT r.* EXCLUDE (phase, seq, sub), {intent_sql("r.query", "b.brand")} AS intent, sha256(r.crawl_run_id || '|' || r.rank) AS opportunity_id FROM ranked0 r LEFT JOIN brands b ON b.crawl_run_id = r.crawl_run_id WHERE rank <= 12
)
"""


def search_with(*parts: str) -> str:
    return "WITH " + ", ".join([CRAWL_SQL, TOPIC_SQL, *parts])


def _kind_sql(condition: str) -> str:
    return search_with(OPP_SQL) + f"SELECT crawl_run_id, query, opportunity_type, relevance, impact, confidence, score, priority, coverage, reason, related_page_id FROM cands WHERE {condition}"


ORACLE_SQL = {
    "slug_phrase": search_with() + f"SELECT page_id, {slug_sql('url')} AS slug FROM crawled",
    "significant_tokens": search_with() + f"SELECT page_id, {tokens_sql('title')} AS tokens FROM crawled",
    "term_candidates": search_with() + f"SELECT page_id, {terms_sql('w')} AS terms FROM (SELECT page_id, {tokens_sql('title')} AS w FROM crawled)",
    "is_utility_page": search_with() + "SELECT page_id, lang IN ('de', 'fr') AS utility FROM crawled JOIN (SELECT pid::VARCHAR AS page_id, lang FROM raw0) USING (page_id)",
    "classify_intent": search_with() + f"SELECT c.crawl_run_id, page_id, {intent_sql('title', 'brand')} AS intent FROM crawled c LEFT JOIN brands b ON b.crawl_run_id = c.crawl_run_id WHERE title IS NOT NULL",
    "site_brand": search_with() + "SELECT * FROM brands",
    "page_profiles": search_with() + "SELECT crawl_run_id, page_id, t AS p_title, m AS p_meta, slug AS p_slug, tt AS title_tokens, mt AS meta_tokens, st AS slug_tokens, list_sort(list_distinct(list_concat(tt, mt, st))) AS all_tokens FROM profiles",
    "extract_topics": search_with() + "SELECT * FROM topics",
    "topics_analyzed": search_with() + "SELECT crawl_run_id, count(*) AS topics FROM topics GROUP BY 1",
    "core_topics": search_with() + "SELECT * FROM core",
    "ai_prompt_topics": search_with()
    + """SELECT crawl_run_id, k AS prompt_rank, term AS topic, 'You are a neutral research assistant. Answer concisely with a short list, and only mention tools, services or websites you are reasonably confident exist. Do not invent anything.'
      || chr(10) || chr(10) || 'Question: What are the best tools, services or websites for "' || term || '"?' AS prompt
      FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY doc_freq DESC, is_bigram DESC, term)::INTEGER AS k FROM topics) WHERE k <= 5""",
    "best_topic_for_page": search_with() + "SELECT * FROM best",
    "content_gap": _kind_sql("opportunity_type = 'CONTENT_GAP'"),
    "weak_topic_coverage": _kind_sql("opportunity_type = 'WEAK_TOPIC_COVERAGE'"),
    "page_optimization": _kind_sql("phase = 2"),
    "search_intent_gap": _kind_sql("phase = 3"),
    "orphan_pages": _kind_sql("phase = 4"),
    "unlinked_topic_pairs": _kind_sql("phase = 5"),
    "score_opportunity": search_with(OPP_SQL) + "SELECT crawl_run_id, related_page_id, score, priority FROM cands WHERE phase = 4",
    "evidence": search_with(OPP_SQL) + "SELECT crawl_run_id, query, page_ids, [query] AS evidence_phrases FROM (SELECT * FROM gap UNION ALL SELECT * FROM weak)",
    "rank_opportunities": search_with(OPP_SQL) + f"SELECT {', '.join(RANKED)} FROM ranked",
    "opportunity_aggregate": search_with(OPP_SQL)
    + " UNION ALL ".join(f"SELECT crawl_run_id, '{k}' AS kind, {c} AS key, count(*) AS n FROM ranked GROUP BY 1, 3" for k, c in (("priority", "priority"), ("type", "opportunity_type"), ("intent", "intent"), ("coverage", "coverage"))),
    "entitled_top_k": search_with(OPP_SQL)
    + """SELECT crawl_run_id, query, opportunity_type, score, related_page_url FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY score DESC, query, opportunity_id) AS k FROM ranked)
      WHERE length(crawl_run_id) % 2 = 0 OR k <= 3""",
    "action_roadmap": search_with(OPP_SQL)
    + """SELECT crawl_run_id, step, query, opportunity_type, priority, score, CASE WHEN opportunity_type = 'CONTENT_GAP' THEN 'create' WHEN opportunity_type = 'INTERNAL_LINK_OPPORTUNITY' THEN 'connect'
      WHEN opportunity_type IN ('EXISTING_PAGE_OPTIMIZATION', 'WEAK_TOPIC_COVERAGE') THEN 'improve' END AS bucket
      FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, score DESC, query, opportunity_id)::INTEGER AS step FROM ranked) WHERE step <= 10""",
}
