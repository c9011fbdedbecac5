"""Queries of AI visibility, discussions, content planning and usage, with their oracles.

Assistant turns of ``conversations`` stand for AI answers, ``documents`` for discussions and
``events`` for usage and subscription logs; what those lack is derived from ids and synthetic.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import discussion_tokens, significant_tokens
from ..operators import audit, content, discussions, opportunities, topics, visibility
from ..sources import versioned
from ..sources.tables import checkpoint_folder, kept_result
from ..streaming import jobs
from .audit_queries import ORACLE_SQL as AUDIT_SQL
from .search_queries import OPP_SQL, priority_sql, search_with, tokens_sql
from .site_tables import crawl_runs, crawled_pages, stored_pages

AS_OF = datetime(2024, 2, 1)


def ai_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    c = c.withColumn("site", e("concat('site', cast(conv_id % 40 as string))"))
    extra = e(
        "case conv_id % 5 when 0 then concat(' See https://www.', site, '.com/x and **Foo: great** best.') when 1 then concat(' You should avoid ', site, ' now.') when 2 then ''"
        " else concat(' https://other', cast(conv_id % 7 as string), '.com/a **Bar/Baz:** useful ', site, '.com.') end"
    )
    return c.select(
        e("concat('c', cast(conv_id % 40 as string))").alias("crawl_run_id"),
        F.concat(F.lit('What are the best tools, services or websites for "'), F.regexp_extract("text", r"^(\S+ \S+)", 1), F.lit('"?')).alias("prompt"),
        F.when(e("conv_id % 5 = 3"), "").otherwise(F.concat("text", extra)).alias("raw_response"),
        F.concat("site", F.lit(".com")).alias("domain"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("flat", F.regexp_replace("text", "[ \t\n\r\f]+", " "))
    words = F.split("flat", " ")
    return d.select(
        e("concat('d', cast(doc_id % 50 as string))").alias("crawl_run_id"),
        F.array_join(F.slice(words, 2, 2), " ").alias("query"),
        e("doc_id % 3").alias("query_ord"),
        F.col("doc_id").alias("post_ord"),
        e("concat('r', cast(doc_id % 7 as string))").alias("subreddit"),
        F.array_join(F.slice(words, 1, 6), " ").alias("title"),
        e("concat('/r/x/', cast(doc_id % 900 as string))").alias("permalink"),
        e("case when doc_id % 6 = 0 then null else 'someone' end").alias("author"),
        e("doc_id * 37 % 900").alias("score"),
        e("doc_id * 17 % 60").alias("num_comments"),
        e("case when doc_id % 11 = 0 then null else timestamp '2024-01-25 00:00:00' - make_dt_interval(cast(doc_id % 400 as int)) end").alias("created_at"),
        F.when(e("doc_id % 5 = 0"), None).otherwise(F.substring("flat", 1, 500)).alias("body_snippet"),
    )


def _core_terms(p: DataFrame) -> DataFrame:
    rows = p.select("crawl_run_id", "post_ord", F.explode(F.array_distinct(significant_tokens(F.col("title")))).alias("term"))
    return rows.groupBy("crawl_run_id", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("crawl_run_id", "term")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return discussions.score_discussions(p, _core_terms(p), AS_OF)


def _ranked(operator):
    return lambda s, d: operator(discussions.rank_discussions(_scored(s, d)))


def _answers(operator):
    return lambda s, d: operator(visibility.analyzed(ai_answers(s, d)))


def _plan(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = stored_pages(spark, sf_dir)
        runs = crawl_runs(pages)
        found = topics.extract_topics(topics.topic_pages(topics.page_profiles(pages)))
        asked = topics.ai_prompt_topics(found).withColumn("mentioned", F.col("prompt_rank") % 2 == 0)
        seeds = content.content_seeds(pages, opportunities.rank_opportunities(pages), audit.all_issues(pages, runs), found, asked)
        return operator(content.plan_content(seeds))

    return query


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").alias("scanned_at"))


def subscription_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "user_id",
        F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("subscription_id"),
        F.expr("case event_type when 'purchase' then 'active' when 'signup' then 'renewed' else 'cancelled' end").alias("status"),
        F.col("ts").alias("event_ts"),
        "event_id",
    )


def subscription_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a payment provider sends them: without a user, whom metadata (two spellings) or an e-mail address names."""
    k, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    named = F.when(k == 0, F.create_map(F.lit("userId"), user)).when(k == 1, F.create_map(F.lit("user_id"), user)).when(k == 2, F.create_map(F.lit("userId"), F.lit("gone")))
    mail = F.when(k >= 2, F.concat(F.lit("u"), user, F.lit("@example.org"))).when(k == 1, "nobody@example.org")
    return subscription_rows(spark, sf_dir).select("event_id", F.concat(F.lit("subscription."), "status").alias("event_type"), "subscription_id", named.alias("metadata"), mail.alias("customer_email"), "status", "event_ts")


def _arriving(spark: SparkSession, folder: str, parts: list[DataFrame], start) -> None:
    """Files arrive part by part in ``folder``/in, and the stream takes up each part where it left off."""
    for k, part in enumerate(parts):
        part.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), k).trigger(availableNow=True).start().awaitTermination()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _fetches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Fetches of all pages, later ones of every other page that fail, and what runs start from, in two parts.

    Of every fourth page the later fetch arrives first.
    """
    p = stored_pages(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_seq") % 1000)
    first = p.select("crawl_run_id", "url", "status_code", "content_type", "internal_links", at.alias("fetched_at"), "page_seq")
    later = first.where("page_seq % 2 = 0").withColumn("status_code", F.lit(500)).withColumn("fetched_at", F.col("fetched_at") + F.expr("interval 1 hour"))
    starts = crawl_runs(p).select(
        "crawl_run_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("content_type"),
        F.array(F.concat("website_url", F.lit("/"))).alias("internal_links"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched_at"), F.lit(1).cast("bigint").alias("page_seq"),
    )
    turned = F.col("page_seq") % 4 == 0
    parts = first.where(~turned).unionByName(later.where(turned)).unionByName(starts), first.where(turned).unionByName(later.where(~turned))
    return [x.drop("page_seq") for x in parts]


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "counters")
    _arriving(spark, folder, _fetches(spark, sf_dir), lambda arriving, k: jobs.stream_crawl_counters(arriving, f"{folder}/out", f"{folder}/state"))
    return kept_result(jobs.counters_so_far(spark.read.parquet(f"{folder}/out")), folder)


def _batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = _fetches(spark, sf_dir)
    return jobs.crawl_counters(first.unionByName(later))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counted by the stream: the log arrives in two parts, split at the middle of its time."""
    log, folder = usage_log(spark, sf_dir).withColumn("scanned_at", F.col("scanned_at").cast("timestamp")), _folder(spark, "usage")
    middle = log.agg((F.unix_micros(F.min("scanned_at")) + F.unix_micros(F.max("scanned_at"))) / 2).first()[0] or 0
    late = F.unix_micros("scanned_at") > middle
    _arriving(spark, folder, [log.where(~late), log.where(late)], lambda arriving, k: jobs.stream_usage(arriving, f"{folder}/days", f"{folder}/state", buckets=8))
    return kept_result(jobs.usage_so_far(spark, f"{folder}/days"), folder)


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans from the stream of raw events, which arrive in two parts; half of the users are known with the second part only."""
    events, folder = subscription_events(spark, sf_dir), _folder(spark, "subscriptions")
    users = subscription_rows(spark, sf_dir).select(F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("u"), "user_id", F.lit("@example.org")).alias("email")).distinct()
    known = [users.where("cast(user_id as bigint) % 2 = 0"), users]
    parts = [events.where("event_id % 3 > 0"), events.where("event_id % 3 = 0")]
    _arriving(spark, folder, parts, lambda arriving, k: jobs.stream_subscriptions(arriving, lambda: known[k], f"{folder}/table", f"{folder}/state", patience_days=100_000, buckets=8))
    plans = jobs.subscription_state(jobs.subscriptions_so_far(spark, f"{folder}/table"))
    return kept_result(plans.select(F.col("user_id").cast("bigint").alias("user_id"), "plan"), folder)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows merged into a stored table in two parts, the later half of them first."""
    rows, folder = subscription_rows(spark, sf_dir), _folder(spark, "upsert")
    by = ["subscription_id"], ["event_ts", "event_id"]
    for part in (rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0")):
        versioned.upsert_table(part, folder, *by, buckets=8)
    return kept_result(versioned.read_upserted(spark, folder, *by), folder)


def _terms(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = stored_pages(spark, sf_dir)
        return operator(discussions.discussion_terms(pages, opportunities.rank_opportunities(pages)))

    return query


def _brief_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    head = F.when(F.col("post_ord") % 5 == 0, F.lit("no labels")).otherwise(F.concat(F.lit("Here:\ntitle: q "), F.trim("query")))
    text = F.concat(head, F.when(F.col("post_ord") % 3 == 0, F.lit("\nINTENT: commercial ")).otherwise(F.lit("")), F.lit("\nSTRUCTURE:\n- one\n2. two\n\n* "), F.trim("subreddit"))
    b = content.parse_brief_text(text)
    return p.select("post_ord", b["title"].alias("title"), b["intent"].alias("intent"), b["structure"].alias("structure"))


def _enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = opportunities.rank_opportunities(crawled_pages(spark, sf_dir))
    text = F.concat(F.lit("ANGLE: "), F.when(F.col("rank") % 4 == 0, F.lit("new angle")).otherwise(F.lit("")), F.lit("\nTITLE: T"), F.col("rank").cast("string"), F.lit("\nSTRUCTURE:\n- a\n- b\nKEY_POINTS:\n"))
    parsed = found.where("rank % 2 = 0").select("opportunity_id", content.parse_enhancement_text(text).alias("e")).select("opportunity_id", "e.*")
    return content.apply_brief_enhancement(content.opportunity_brief(found), parsed).select("opportunity_id", "target_topic", "suggested_title", "structure", "ai_enhanced", (F.col("angle") == "new angle").alias("new_angle"))


QUERIES = {
    "discussion_terms": _terms(lambda t: t),
    "noise_filter": _terms(discussions.noise_filter),
    "rank_discussion_queries": _terms(lambda t: discussions.rank_discussion_queries(discussions.noise_filter(t))),
    "core_discussion_terms": _terms(lambda t: discussions.core_discussion_terms(discussions.noise_filter(t))),
    "parse_brief_text": _brief_texts,
    "apply_brief_enhancement": _enhanced,
    "discussion_tokens": lambda s, d: posts(s, d).select("post_ord", discussion_tokens(F.col("title")).alias("tokens")),
    "coverage_for_type": lambda s, d: opportunities.rank_opportunities(crawled_pages(s, d)).select("crawl_run_id", "rank", R.coverage_for_type(F.col("opportunity_type")).alias("coverage")),
    "score_to_priority": lambda s, d: _scored(s, d).select("post_ord", R.priority_of(F.col("opportunity_score")).alias("priority")),
    "score_labels": _answers(lambda r: r.select("answer_id", R.health_label(F.col("visibility_score")).alias("health"), R.visibility_label(F.col("visibility_score")).alias("visibility"))),
    "mention_analysis": _answers(lambda r: r.select("answer_id", "mentioned", "cited", "stance", F.array_sort("competitors").alias("competitors"))),
    "visibility_score": _answers(lambda r: r.select("answer_id", "visibility_score")),
    "visibility_reason": _answers(lambda r: r.select("answer_id", "reason")),
    "display_score": _answers(lambda r: r.select("answer_id", visibility.display_score(F.col("visibility_score")).alias("display"))),
    "topic_from_prompt": _answers(lambda r: r.select("answer_id", visibility.topic_from_prompt(F.col("prompt")).alias("view_topic"), visibility.planner_topic(F.col("prompt")).alias("plan_topic"))),
    "build_prompts": lambda s, d: posts(s, d).select("post_ord", topics.build_prompt(F.col("query")).alias("prompt")),
    "visibility_summary": _answers(visibility.visibility_summary),
    "visibility_rates": _answers(visibility.visibility_rates),
    "top_competitors": _answers(visibility.top_competitors),
    "visibility_actions": _answers(visibility.visibility_actions),
    "score_discussions": lambda s, d: _scored(s, d).select("post_ord", "relevance", "impact", "confidence", "opportunity_score", "priority", "reason"),
    "rank_discussions": _ranked(lambda r: r.select("crawl_run_id", "place", "permalink", "opportunity_score", "post_ord")),
    "subreddit_rollup": _ranked(discussions.subreddit_rollup),
    "discussion_topic_share": _ranked(discussions.discussion_topic_share),
    "customer_phrases": _ranked(discussions.customer_phrases),
    "outline_for_intent": lambda s, d: posts(s, d).select("post_ord", content.outline_for_intent(F.expr("case post_ord % 4 when 0 then 'commercial' when 1 then 'Transactional' when 2 then 'on-page' else 'informational' end"), F.col("query")).alias("outline")),
    "opportunity_brief": lambda s, d: content.opportunity_brief(opportunities.rank_opportunities(crawled_pages(s, d))).select("crawl_run_id", "target_topic", "search_intent", "coverage", "angle", "suggested_title", "structure", "opportunity"),
    "plan_content": _plan(lambda p: p.select("crawl_run_id", "place", "topic", "source_type", "priority", "intent")),
    "plan_briefs": _plan(lambda p: content.plan_briefs(p, p.where("place % 2 = 0").select("crawl_run_id", "topic", F.concat(F.lit("T "), "topic").alias("title"), F.lit("x").alias("intent"), F.array(F.lit("a")).alias("structure")))),
    "plan_prompts": _plan(lambda p: p.select("crawl_run_id", "place", content.plan_prompt(F.col("topic"), F.col("reference"), F.col("intent"), F.col("crawl_run_id")).alias("prompt"))),
    "brief_prompts": lambda s, d: content.opportunity_brief(opportunities.rank_opportunities(crawled_pages(s, d))).select("opportunity_id", content.brief_prompt(F.col("crawl_run_id")).alias("brief_prompt"), content.draft_prompt(F.col("crawl_run_id")).alias("draft_prompt")),
    "content_action_counts": _plan(content.content_action_counts),
    "content_clusters": _plan(content.content_clusters),
    "stream_crawl_counters": _counters,
    "crawl_counters": _batch_counters,
    "usage_windows": lambda s, d: jobs.usage_windows(usage_log(s, d)),
    "stream_usage": _usage,
    "subscription_state": _subscriptions,
    "upsert_latest": _upsert,
}

_SIG = "CASE WHEN {0} THEN {1} END"
ANSWER_SQL = r"""
WITH base AS (
  SELECT *, 'site' || (conv_id % 40) AS site FROM conversations WHERE role = 'assistant'
), answers AS (
  SELECT 'c' || (conv_id % 40) AS crawl_run_id, 'What are the best tools, services or websites for "' || regexp_extract(text, '^(\S+ \S+)', 1) || '"?' AS prompt,
    CASE WHEN conv_id % 5 = 3 THEN '' ELSE text || CASE conv_id % 5 WHEN 0 THEN ' See https://www.' || site || '.com/x and **Foo: great** best.' WHEN 1 THEN ' You should avoid ' || site || ' now.' WHEN 2 THEN ''
      ELSE ' https://other' || (conv_id % 7) || '.com/a **Bar/Baz:** useful ' || site || '.com.' END END AS raw, site || '.com' AS domain, site AS brand, conv_id || '-' || turn AS answer_id FROM base
), hosts AS (
  SELECT *, list_distinct(list_concat(list_transform(regexp_extract_all(raw, 'https?://[^\s<>"'']+'), lambda u: regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]*)', 1)), '^www\.', '')),
    list_filter(list_transform(regexp_extract_all(lower(raw), '[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)*'), lambda d: regexp_replace(d, '^www\.', '')), lambda d: NOT regexp_matches(d, '^u\.?s\.?$')))) AS hosts FROM answers
), seen AS (
  SELECT *, list_contains(hosts, domain) AS cited, list_contains(hosts, domain) OR contains(lower(raw), domain) OR regexp_matches(lower(raw), '(^|[^a-z0-9_])' || brand || '($|[^a-z0-9_])') AS mentioned,
    regexp_matches(lower(raw), 'avoid|not recommended|do not recommend|poor|disappointing|unreliable|buggy|outdated|skip|lacks|behind') AS neg, regexp_matches(lower(raw), 'recommend|best|top pick|top tool|great choice|good option|excellent|useful|helpful|worth') AS pos,
    list_concat(list_filter(hosts, lambda h: h <> domain), CASE WHEN contains(raw, '**Foo: great**') THEN ['Foo: great'] WHEN contains(raw, '**Bar/Baz:**') THEN ['Bar', 'Baz'] ELSE [] END) AS competitors FROM hosts
), scored0 AS (
  SELECT *, CASE WHEN NOT mentioned THEN 'absent' WHEN neg THEN 'negative' WHEN pos THEN 'recommendation' ELSE 'neutral' END AS stance FROM seen
), results AS (
  SELECT *, greatest(0, least(100, CASE WHEN cited THEN 40 ELSE 0 END + CASE WHEN mentioned THEN 30 + CASE stance WHEN 'recommendation' THEN 30 WHEN 'neutral' THEN 10 ELSE -10 END ELSE 0 END))::INTEGER AS visibility_score,
    coalesce(nullif(regexp_extract(prompt, '"([^"]+)"', 1), ''), prompt) AS topic FROM scored0
)
"""
_DISPLAY = "least(75, greatest(15, floor({0} / 5.0::DOUBLE + 0.5)::INTEGER * 5))"
POST_SQL = f"""
posts AS (
  SELECT 'd' || (doc_id % 50) AS crawl_run_id, array_to_string(w[2:3], ' ') AS query, doc_id % 3 AS query_ord, doc_id AS post_ord, 'r' || (doc_id % 7) AS subreddit, array_to_string(w[1:6], ' ') AS title, '/r/x/' || (doc_id % 900) AS permalink,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'someone' END AS author, doc_id * 37 % 900 AS score, doc_id * 17 % 60 AS num_comments, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 400 + 7 END AS age, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE substr(flat, 1, 500) END AS body
  FROM (SELECT *, string_split(flat, ' ') AS w FROM (SELECT *, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS flat FROM documents))
), ptok AS (SELECT *, {tokens_sql("title")} AS tt, {tokens_sql("body")} AS bt, {tokens_sql("query")} AS qt FROM posts
), terms AS (SELECT crawl_run_id, list(term) AS core FROM (SELECT crawl_run_id, term FROM (SELECT DISTINCT crawl_run_id, post_ord, unnest(tt) AS term FROM ptok) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1
), parts AS (
  SELECT p.*, floor(least(40, 8 + 12 * CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_filter(qt, lambda x: list_contains(tt, x)))::DOUBLE / len(qt) END + 3 * least(6, len(list_filter(list_concat(tt, bt), lambda x: list_contains(coalesce(core, []), x))))) + 0.5)::INTEGER AS relevance,
    floor(least(30, least(1, log2(num_comments + 1) / 5) * 15 + least(1, log10(score + 1) / 3) * 10 + CASE WHEN age < 30 THEN 5 WHEN age < 180 THEN 3 ELSE 0 END) + 0.5)::INTEGER AS impact,
    least(30, 10 + CASE WHEN length(title) >= 15 THEN 6 ELSE 0 END + CASE WHEN author IS NULL THEN 0 ELSE 5 END + CASE WHEN body IS NULL THEN 0 ELSE 6 END + CASE WHEN age IS NULL THEN 0 ELSE 4 END) AS confidence
  FROM ptok p LEFT JOIN terms t ON t.crawl_run_id = p.crawl_run_id
), pscored AS (SELECT *, relevance + impact + confidence AS opportunity_score, {priority_sql("(relevance + impact + confidence)")} AS priority FROM parts
), pranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY opportunity_score DESC, permalink)::INTEGER AS place FROM
    (SELECT * FROM pscored QUALIFY row_number() OVER (PARTITION BY crawl_run_id, permalink ORDER BY query_ord, post_ord) = 1)) WHERE place <= 10
)
"""
_MANY = "{0} || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END"
_ISSUES = "issues AS (" + AUDIT_SQL["issue_counts"].split("issues AS (", 1)[1].split("), every AS", 1)[0] + ")"
_LINKS = "links AS (" + AUDIT_SQL["broken_link_issues"].split("links AS (", 1)[1].split("SELECT crawl_run_id, page_id, 'BROKEN_INTERNAL_LINK'", 1)[0].strip()
PLAN_SQL = f"""
{_LINKS}, {_ISSUES}, fix AS (
  SELECT i.crawl_run_id, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) ELSE url END AS topic, 'SEO_FIX' AS source_type,
    CASE arg_min(severity, list_position(['MISSING_TITLE', 'TITLE_TOO_SHORT', 'MISSING_META_DESCRIPTION'], issue_type)) WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS priority, 2 AS s, min(page_seq) AS o1, '' AS o2, min(slug) AS slug
  FROM issues i JOIN (SELECT c.*, p.slug FROM crawled c JOIN profiles p USING (crawl_run_id, page_id)) c ON c.crawl_run_id = i.crawl_run_id AND c.page_id = i.page_id
  WHERE issue_type IN ('MISSING_TITLE', 'TITLE_TOO_SHORT', 'MISSING_META_DESCRIPTION') GROUP BY i.crawl_run_id, i.page_id, title, url
), seeds AS (
  SELECT crawl_run_id, query AS topic, opportunity_type AS source_type, priority, 1 AS s, score AS o1, opportunity_id AS o2 FROM ranked WHERE opportunity_type IN ('CONTENT_GAP', 'SEARCH_INTENT_GAP', 'WEAK_TOPIC_COVERAGE')
  UNION ALL SELECT crawl_run_id, CASE WHEN starts_with(topic, 'http') AND slug <> '' THEN slug ELSE topic END, source_type, priority, s, o1, o2 FROM fix
  UNION ALL SELECT crawl_run_id, term, 'CORE_TOPIC', 'medium', 3, -doc_freq, term FROM topics WHERE doc_freq >= 2 AND dedicated_pages = 0
  UNION ALL SELECT crawl_run_id, term, 'AI_VISIBILITY_GAP', 'high', 4, 0, term FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY doc_freq DESC, is_bigram DESC, term) AS k FROM topics) WHERE k IN (1, 3, 5)
), plan AS (
  SELECT crawl_run_id, place, topic, source_type, priority, CASE WHEN source_type IN ('SEARCH_INTENT_GAP', 'AI_VISIBILITY_GAP') THEN 'commercial' WHEN source_type = 'SEO_FIX' THEN 'on-page' ELSE 'informational' END AS intent FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, list_position(['CONTENT_GAP', 'SEARCH_INTENT_GAP', 'WEAK_TOPIC_COVERAGE', 'AI_VISIBILITY_GAP', 'CORE_TOPIC', 'SEO_FIX'], source_type), topic)::INTEGER AS place
    FROM (SELECT * FROM seeds WHERE length(trim(topic)) >= 3 QUALIFY row_number() OVER (PARTITION BY crawl_run_id, lower(trim(topic)) ORDER BY s, o1, o2) = 1)) WHERE place <= 6
)
"""


def _outline(intent: str, topic: str) -> str:
    return (
        f"CASE WHEN contains(lower({intent}), 'commercial') THEN ['Introduction', 'Why ' || {topic} || ' matters', 'Comparison of options', 'Recommendations', 'Summary and next steps']"
        f" WHEN contains(lower({intent}), 'transactional') THEN ['Introduction', 'Features of ' || {topic}, 'Pricing and options', 'Frequently asked questions', 'Get started']"
        f" WHEN contains(lower({intent}), 'on-page') THEN ['Overview of ' || {topic}, 'Key points to communicate', 'Suggested heading structure', 'Meta description and title rewrite']"
        f" ELSE ['Introduction', 'What is ' || {topic}, 'Common questions about ' || {topic}, 'How to use ' || {topic} || ' effectively', 'Summary and next steps'] END"
    )


def _cap(x: str) -> str:
    return rf"upper(substr(regexp_replace(trim({x}), '\s+', ' ', 'g'), 1, 1)) || substr(regexp_replace(trim({x}), '\s+', ' ', 'g'), 2)"


_PROMPT = "'You are a neutral research assistant. Answer concisely with a short list, and only mention tools, services or websites you are reasonably confident exist. Do not invent anything.' || chr(10) || chr(10) || 'Question: What are the best tools, services or websites for \"' || {0} || '\"?'"
_PLAN = search_with(OPP_SQL, PLAN_SQL)
_SUBS = "WITH subs AS (SELECT user_id, user_id || '-' || (event_id % 3) AS subscription_id, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'signup' THEN 'renewed' ELSE 'cancelled' END AS status, ts AS event_ts, event_id FROM events) "
_COUNTERS = search_with("found AS (SELECT crawl_run_id, website_url || '/' AS url FROM runs UNION SELECT crawl_run_id, unnest(internal_links) FROM content)") + """SELECT c.crawl_run_id, c.crawled, c.ok, f.discovered
      FROM (SELECT crawl_run_id, count(*) AS crawled, count(*) FILTER (status_code = 200) AS ok FROM crawled GROUP BY 1) c JOIN (SELECT crawl_run_id, count(*) AS discovered FROM found GROUP BY 1) f USING (crawl_run_id)"""
_USAGE = """WITH u AS (SELECT user_id, 'week' AS period, date_trunc('week', ts)::TIMESTAMP AS start, count(*) AS scans, 2 AS most FROM events GROUP BY 1, 3
      UNION ALL SELECT user_id, 'month', date_trunc('month', ts)::TIMESTAMP, count(*), 8 FROM events GROUP BY 1, 3) SELECT *, greatest(0, most - scans)::BIGINT AS left, CASE WHEN period = 'month' THEN least(40, scans * 10)::BIGINT END AS conversations FROM u"""

ORACLE_SQL = {
    "parse_brief_text": f"WITH {POST_SQL} SELECT post_ord, CASE WHEN post_ord % 5 > 0 THEN trim('q ' || trim(query)) END AS title, CASE WHEN post_ord % 5 > 0 THEN CASE WHEN post_ord % 3 = 0 THEN 'commercial' ELSE 'informational' END END AS intent, CASE WHEN post_ord % 5 > 0 THEN ['one', 'two', subreddit] END AS structure FROM posts",
    "apply_brief_enhancement": search_with(OPP_SQL)
    + f"""SELECT opportunity_id, query AS target_topic, CASE WHEN rank % 2 = 0 THEN 'T' || rank ELSE {_cap("query")} END AS suggested_title, CASE WHEN rank % 2 = 0 THEN ['a', 'b'] ELSE {_outline("intent", "query")} END AS structure, rank % 2 = 0 AS ai_enhanced, rank % 4 = 0 AS new_angle FROM ranked""",
    "discussion_tokens": f"WITH {POST_SQL} SELECT post_ord, {tokens_sql('title', 3)} AS tokens FROM posts",
    "coverage_for_type": search_with(OPP_SQL) + "SELECT crawl_run_id, rank, coverage FROM ranked",
    "score_to_priority": f"WITH {POST_SQL} SELECT post_ord, priority FROM pscored",
    "score_labels": ANSWER_SQL
    + """SELECT answer_id, CASE WHEN visibility_score >= 90 THEN 'Excellent' WHEN visibility_score >= 75 THEN 'Healthy' WHEN visibility_score >= 60 THEN 'Good' WHEN visibility_score >= 40 THEN 'Needs Fixes' ELSE 'Critical' END AS health,
      CASE WHEN visibility_score >= 60 THEN 'Strong' WHEN visibility_score >= 40 THEN 'Moderate' WHEN visibility_score >= 25 THEN 'Low' ELSE 'Very Low' END AS visibility FROM results""",
    "mention_analysis": ANSWER_SQL + "SELECT answer_id, mentioned, cited, stance, list_sort(competitors) AS competitors FROM results",
    "visibility_score": ANSWER_SQL + "SELECT answer_id, visibility_score FROM results",
    "visibility_reason": ANSWER_SQL
    + """SELECT answer_id, CASE WHEN trim(raw) = '' THEN 'The model returned an empty response for "' || topic || '".' WHEN NOT mentioned THEN '"' || domain || '" was not mentioned in the answer to "' || topic || '".'
      WHEN cited THEN '"' || domain || '" was mentioned and linked in the answer to "' || topic || '".' ELSE '"' || domain || '" appeared in the answer to "' || topic || '" (' || stance || ').' END AS reason FROM results""",
    "display_score": ANSWER_SQL + f"SELECT answer_id, {_DISPLAY.format('visibility_score')} AS display FROM results",
    "topic_from_prompt": ANSWER_SQL + "SELECT answer_id, topic AS view_topic, trim(topic) AS plan_topic FROM results",
    "build_prompts": f"WITH {POST_SQL} SELECT post_ord, {_PROMPT.format('query')} AS prompt FROM posts",
    "visibility_summary": ANSWER_SQL
    + f"SELECT *, {_DISPLAY.format('score')} AS display FROM (SELECT crawl_run_id, count(*) AS answers, count(*) FILTER (mentioned) AS mentioned, count(*) FILTER (cited) AS cited, count(*) FILTER (stance = 'recommendation') AS recommended, floor(avg(visibility_score) + 0.5)::INTEGER AS score FROM results GROUP BY 1)",
    "visibility_rates": ANSWER_SQL
    + """SELECT *, CASE WHEN topic_pct >= 70 THEN 'Strong' WHEN topic_pct >= 40 THEN 'Partial' ELSE 'Weak' END AS topic_level FROM (SELECT crawl_run_id, floor(count(*) FILTER (mentioned)::DOUBLE / count(*) * 100 + 0.5)::INTEGER AS mention_pct, floor(count(*) FILTER (cited)::DOUBLE / count(*) * 100 + 0.5)::INTEGER AS cite_pct,
      count(*) FILTER (stance = 'recommendation') AS recommendation, count(*) FILTER (stance = 'neutral') AS neutral, count(*) FILTER (stance = 'negative') AS negative, floor(count(*) FILTER (mentioned OR cited)::DOUBLE / count(*) * 100 + 0.5)::INTEGER AS topic_pct FROM results GROUP BY 1)""",
    "top_competitors": ANSWER_SQL
    + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id ORDER BY answers DESC, competitor)::INTEGER AS place FROM (SELECT crawl_run_id, unnest(competitors) AS competitor, count(*) AS answers FROM results GROUP BY 1, 2)) WHERE place <= 6",
    "visibility_actions": ANSWER_SQL
    + """, a AS (SELECT crawl_run_id, count(*) FILTER (NOT mentioned) AS missing, count(*) FILTER (mentioned) AS m, count(*) FILTER (cited) AS c, count(*) FILTER (len(competitors) > 0) AS r FROM results GROUP BY 1), t AS (
      SELECT crawl_run_id, 1 AS k, 'high' AS priority, 'Expand content coverage for ' || missing || ' missing topic' || CASE WHEN missing > 1 THEN 's' ELSE '' END AS title FROM a WHERE missing > 0
      UNION ALL SELECT crawl_run_id, 2, 'high', 'Improve citation readiness' FROM a WHERE m > 0 AND c = 0 UNION ALL SELECT crawl_run_id, 3, 'medium', 'Strengthen cited topics' FROM a WHERE m > 0 AND c > 0
      UNION ALL SELECT crawl_run_id, 4, 'medium', 'Analyze competitor visibility' FROM a WHERE r > 0) SELECT crawl_run_id, row_number() OVER (PARTITION BY crawl_run_id ORDER BY k)::INTEGER AS step, priority, title FROM t""",
    "score_discussions": f"WITH {POST_SQL} SELECT post_ord, relevance, impact, confidence, opportunity_score, priority, '\"' || title || '\" in r/' || subreddit || ' (' || {_MANY.format('num_comments', 'comment')} || ' · ' || {_MANY.format('score', 'point')} || CASE WHEN age IS NULL THEN '' ELSE ' · ' || {_MANY.format('age', 'day')} || ' old' END || ') relates to topic \"' || query || '\".' AS reason FROM pscored",
    "rank_discussions": f"WITH {POST_SQL} SELECT crawl_run_id, place, permalink, opportunity_score, post_ord FROM pranked",
    "subreddit_rollup": f"WITH {POST_SQL} SELECT *, floor(posts::DOUBLE / sum(posts) OVER (PARTITION BY crawl_run_id) * 100 + 0.5)::INTEGER AS pct FROM (SELECT crawl_run_id, subreddit, count(*) AS posts, count(*) FILTER (priority = 'high') AS high FROM pranked GROUP BY 1, 2)",
    "discussion_topic_share": f"WITH {POST_SQL} SELECT *, sum(posts) OVER (PARTITION BY crawl_run_id)::BIGINT AS of_posts FROM (SELECT crawl_run_id, query, count(*) AS posts FROM pranked GROUP BY 1, 2)",
    "customer_phrases": f"WITH {POST_SQL} SELECT DISTINCT crawl_run_id, phrase FROM (SELECT crawl_run_id, array_to_string(list_filter(string_split(title, ' '), lambda w: length(w) > 3)[1:4], ' ') AS phrase FROM pranked WHERE place <= 8) WHERE length(phrase) > 5",
    "outline_for_intent": f"WITH {POST_SQL} SELECT post_ord, {_outline('i', 'query')} AS outline FROM (SELECT *, CASE post_ord % 4 WHEN 0 THEN 'commercial' WHEN 1 THEN 'Transactional' WHEN 2 THEN 'on-page' ELSE 'informational' END AS i FROM posts)",
    "opportunity_brief": search_with(OPP_SQL)
    + f"""SELECT crawl_run_id, query AS target_topic, intent AS search_intent, coverage, CASE WHEN coverage = 'GAP' THEN 'Publish new, dedicated coverage that directly targets "' || query || '" from scratch.'
      ELSE 'Improve and expand the existing coverage of "' || query || '" so it fully satisfies the search intent.' END AS angle, {_cap('query')} AS suggested_title, {_outline('intent', 'query')} AS structure, reason AS opportunity FROM ranked""",
    "plan_content": _PLAN + "SELECT * FROM plan",
    "plan_briefs": _PLAN + f"SELECT crawl_run_id, place, topic, CASE WHEN place % 2 = 0 THEN 'T ' || topic ELSE {_cap('topic')} END AS title, CASE WHEN place % 2 = 0 THEN 'x' ELSE intent END AS intent, CASE WHEN place % 2 = 0 THEN ['a'] ELSE {_outline('intent', 'topic')} END AS structure, place % 2 = 0 AS ai_enhanced FROM plan",
    "plan_prompts": search_with(OPP_SQL, PLAN_SQL.rstrip() + """, refs AS (
      SELECT p.crawl_run_id, p.place, p.topic, p.intent, CASE p.source_type
        WHEN 'SEO_FIX' THEN (SELECT 'Page ' || f.url || ' (' || f.types || ')' FROM fix_refs f WHERE f.crawl_run_id = p.crawl_run_id AND lower(trim(f.topic)) = lower(trim(p.topic)) ORDER BY f.o1 LIMIT 1)
        WHEN 'CORE_TOPIC' THEN (SELECT 'Core topic "' || t.term || '" referenced on ' || t.doc_freq || ' pages, no dedicated page' FROM topics t WHERE t.crawl_run_id = p.crawl_run_id AND t.term = p.topic)
        WHEN 'AI_VISIBILITY_GAP' THEN 'AI visibility gap: provider answered "' || p.topic || '" without mentioning the site'
        ELSE (SELECT 'Search opportunity "' || r.query || '" (' || r.opportunity_type || ', priority ' || r.priority || '): ' || r.reason FROM ranked r WHERE r.crawl_run_id = p.crawl_run_id AND lower(trim(r.query)) = lower(trim(p.topic)) AND r.opportunity_type IN ('CONTENT_GAP', 'SEARCH_INTENT_GAP', 'WEAK_TOPIC_COVERAGE') ORDER BY r.score, r.opportunity_id LIMIT 1) END AS reference
      FROM plan p
    )""").replace("), seeds AS (", """), fix_refs AS (
      SELECT i.crawl_run_id, CASE WHEN trim(coalesce(c.title, '')) <> '' THEN trim(c.title) WHEN c.slug <> '' THEN c.slug ELSE c.url END AS topic, c.url, min(c.page_seq) AS o1,
        string_agg(issue_type, '; ' ORDER BY list_position(['MISSING_TITLE', 'TITLE_TOO_SHORT', 'MISSING_META_DESCRIPTION'], issue_type)) AS types
      FROM issues i JOIN profiles c ON c.crawl_run_id = i.crawl_run_id AND c.page_id = i.page_id WHERE issue_type IN ('MISSING_TITLE', 'TITLE_TOO_SHORT', 'MISSING_META_DESCRIPTION') GROUP BY i.crawl_run_id, c.page_id, c.title, c.slug, c.url
    ), seeds AS (""", 1)
    + """SELECT crawl_run_id, place, concat_ws(chr(10), 'You are an SEO content strategist for the website ' || crawl_run_id || '.', 'Derived from a real crawl, this topic is relevant: "' || topic || '".', 'Evidence: ' || reference || '.', 'Target intent: ' || intent || '.',
      'Write a short content brief with exactly three labelled parts:', 'TITLE: one concrete article title under 70 characters.', 'INTENT: the primary intent the page should satisfy.', 'STRUCTURE: a 3-6 point bullet outline (H2 sections) with a short phrase per point.',
      'Base everything only on the provided evidence. Do not invent metrics such as search volume, CPC, rankings or traffic.') AS prompt FROM refs""",
    "content_clusters": _PLAN.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, t AS (
      SELECT crawl_run_id, place, topic, list_filter(string_split_regex(lower(topic), '[^a-z0-9]+'), lambda w: length(w) > 3) AS words FROM plan
    ), b AS (
      SELECT DISTINCT crawl_run_id, 0 AS k, []::STRUCT(word VARCHAR, topics VARCHAR[])[] AS buckets FROM plan
      UNION ALL
      SELECT crawl_run_id, k + 1, CASE WHEN topic IS NULL OR len(words) = 0 THEN buckets WHEN home IS NULL THEN list_append(buckets, {'word': words[1], 'topics': [topic]})
        ELSE list_transform(buckets, lambda x: CASE WHEN x.word = home THEN {'word': x.word, 'topics': list_append(x.topics, topic)} ELSE x END) END
      FROM (SELECT b.*, t.topic, t.words, list_filter(t.words, lambda w: list_contains(list_transform(b.buckets, lambda x: x.word), w))[1] AS home FROM b LEFT JOIN t ON t.crawl_run_id = b.crawl_run_id AND t.place = b.k + 1 WHERE b.k < 6)
    )
    SELECT crawl_run_id, upper(x.word[1]) || x.word[2:] AS cluster, x.topics AS topics FROM (SELECT crawl_run_id, unnest(buckets) AS x FROM b WHERE k = 6) WHERE len(x.topics) >= 2""",
    "content_action_counts": _PLAN + "SELECT crawl_run_id, CASE WHEN source_type IN ('SEARCH_INTENT_GAP', 'WEAK_TOPIC_COVERAGE') THEN 'Expand topic coverage' WHEN source_type = 'SEO_FIX' THEN 'Improve existing page' ELSE 'Create new content' END AS action, count(*) AS n FROM plan GROUP BY 1, 2",
    "crawl_counters": _COUNTERS,
    "stream_crawl_counters": _COUNTERS,
    "usage_windows": _USAGE,
    "stream_usage": _USAGE,
    "subscription_state": _SUBS
    + """, last AS (SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY event_ts DESC, event_id DESC) = 1)
      SELECT user_id, CASE WHEN arg_max(status, (event_ts, event_id)) IN ('active', 'renewed') OR count(*) FILTER (status = 'active') > 0 THEN 'pro' ELSE 'free' END AS plan FROM last GROUP BY 1""",
    "upsert_latest": _SUBS + "SELECT * FROM subs QUALIFY row_number() OVER (PARTITION BY subscription_id ORDER BY event_ts DESC, event_id DESC) = 1",
}
