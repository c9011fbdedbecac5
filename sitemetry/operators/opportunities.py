"""Search opportunities from topics, page signals and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.text import js_round
from ..functions.urls import is_utility_page
from ..sources.tables import cut_lineage
from .topics import best_topics, brands_of, core_topics, extract_topics, page_profiles, topic_pages

COLUMNS = ["crawl_run_id", "query", "opportunity_type", "relevance", "impact", "confidence", "reason", "suggested_action", "related_page_id", "related_page_url", "evidence_pages", "evidence_phrases", "gen_ord"]


def scored(rows: DataFrame) -> DataFrame:
    """Parts of the score rounded and clamped, total, priority, coverage."""
    part = lambda name, most: js_round(F.greatest(F.lit(0), F.least(F.lit(most), F.col(name)))).alias(name)
    limits = {"relevance": R.RELEVANCE_MAX, "impact": R.IMPACT_MAX, "confidence": R.CONFIDENCE_MAX}
    rows = rows.select(*[part(c, limits[c]) if c in limits else F.col(c) for c in rows.columns])
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.col("relevance") + F.col("impact") + F.col("confidence")))
    return rows.withColumn("score", total).withColumn("priority", R.priority_of(F.col("score"))).withColumn("coverage", R.coverage_for_type(F.col("opportunity_type")))


def _relevance(freq: Column, other: int) -> Column:
    return F.when(freq.isNull(), F.lit(other)).otherwise(F.least(F.lit(R.RELEVANCE_MAX), 5 * F.least(freq, F.lit(8))))


def _page_ref(url: str = "url", page: str = "page_id") -> Column:
    return F.struct(F.col(url).alias("url"), F.col(page).alias("id"))


def _order(phase: int, at: Column, sub: Column | None = None) -> Column:
    """Place in the order of generation: phase, topic rank or page, rule."""
    return F.struct(F.lit(phase).alias("phase"), at.cast("bigint").alias("at"), (F.lit(0) if sub is None else sub).cast("bigint").alias("sub"))


def topic_opportunities(profiles: DataFrame, on_pages: DataFrame, core: DataFrame) -> DataFrame:
    """CONTENT_GAP for core topics without a page of their own, WEAK_TOPIC_COVERAGE for thin ones."""
    words = F.coalesce(F.col("word_count"), F.lit(0))
    facts = profiles.select("crawl_run_id", "page_id", "url", words.alias("words"))
    covering = on_pages.join(core.select("crawl_run_id", "term", "doc_freq", "dedicated_pages", "topic_rank"), ["crawl_run_id", "term"]).join(facts, ["crawl_run_id", "page_id"])
    own = F.col("dedicated")
    page = F.struct("page_seq", "words", "url", "page_id")
    by_words = F.struct((-F.col("words")).alias("less"), "page_seq", "url", "page_id")
    gap = F.col("dedicated_pages") == 0
    # Only a few evidence pages are kept, so only pages that can be among them are collected.
    place_words = F.row_number().over(Window.partitionBy("crawl_run_id", "term").orderBy(F.desc("words"), "page_seq"))
    place_page = F.row_number().over(Window.partitionBy("crawl_run_id", "term").orderBy(F.desc("dedicated"), "page_seq"))
    ranked = covering.withColumn("by_words", place_words).withColumn("by_page", place_page)
    topics = ranked.groupBy("crawl_run_id", "term", "doc_freq", "dedicated_pages", "topic_rank").agg(
        F.sum("words").alias("total_words"),
        F.count_if(own & (F.col("words") < R.THIN_WORDS)).alias("thin"),
        F.array_sort(F.collect_list(F.when(gap & (F.col("by_words") <= 5), by_words))).alias("longest"),
        F.array_sort(F.collect_list(F.when(~gap & own & (F.col("by_page") <= 5), page))).alias("first"),
        F.min(F.when(~gap & own, by_words)).alias("longest_own"),
    )
    weak = ~gap & ((F.col("total_words") < R.WEAK_COVERAGE_WORDS) | (F.col("thin") > 0))
    term, df, ded, total = F.col("term"), F.col("doc_freq"), F.col("dedicated_pages"), F.col("total_words")
    lead = F.when(gap, F.get("longest", F.lit(0))).otherwise(F.col("longest_own"))
    evidence = F.when(gap, F.transform("longest", lambda x: F.struct(x["url"].alias("url"), x["page_id"].alias("id")))).otherwise(F.transform("first", lambda x: F.struct(x["url"].alias("url"), x["page_id"].alias("id"))))
    return topics.where(gap | weak).select(
        "crawl_run_id",
        term.alias("query"),
        F.when(gap, "CONTENT_GAP").otherwise("WEAK_TOPIC_COVERAGE").alias("opportunity_type"),
        _relevance(df, 5).alias("relevance"),
        F.when(gap, F.lit(R.IMPACT_MAX)).otherwise(F.greatest(F.lit(5), R.IMPACT_MAX - F.floor(total / 50))).alias("impact"),
        F.least(F.lit(R.CONFIDENCE_MAX), F.when(gap, 10 + 4 * df).otherwise(10 + 3 * df + 2 * ded)).alias("confidence"),
        F.when(gap, F.format_string('The site references "%s" on %d page(s) but no page targets it directly.', term, df))
        .otherwise(F.format_string('"%s" is covered by only %d words across %d page(s).', term, total, ded))
        .alias("reason"),
        F.when(gap, F.format_string('Create a dedicated, indexable page focused on "%s".', term))
        .otherwise(F.format_string(f'Expand coverage of "%s" with at least {R.WEAK_COVERAGE_WORDS} words of dedicated content.', term))
        .alias("suggested_action"),
        lead["page_id"].alias("related_page_id"),
        lead["url"].alias("related_page_url"),
        evidence.alias("evidence_pages"),
        F.array(term).alias("evidence_phrases"),
        _order(1, F.col("topic_rank")).alias("gen_ord"),
    )


def _page_row(rows: DataFrame, opportunity_type: str, rules: list[dict], phase: int, most: int) -> DataFrame:
    """Opportunities of single pages: the first ``most`` rules that fit each page."""
    options = [
        F.when(
            r["when"],
            F.struct(
                r["query"].alias("query"),
                r["relevance"].cast("bigint").alias("relevance"),
                r["impact"].cast("bigint").alias("impact"),
                r["confidence"].cast("bigint").alias("confidence"),
                r["reason"].alias("reason"),
                r["action"].alias("suggested_action"),
                r["phrase"].alias("phrase"),
                F.lit(i).alias("sub"),
            ),
        )
        for i, r in enumerate(rules)
    ]
    kept = F.slice(F.filter(F.array(*options), lambda x: x.isNotNull()), 1, most)
    out = rows.select("crawl_run_id", "page_id", "url", "page_seq", F.explode(kept).alias("o"))
    return out.select(
        "crawl_run_id",
        "o.query",
        F.lit(opportunity_type).alias("opportunity_type"),
        "o.relevance",
        "o.impact",
        "o.confidence",
        "o.reason",
        "o.suggested_action",
        F.col("page_id").alias("related_page_id"),
        F.col("url").alias("related_page_url"),
        F.array(_page_ref()).alias("evidence_pages"),
        F.array("o.phrase").alias("evidence_phrases"),
        _order(phase, F.col("page_seq"), F.col("o.sub")).alias("gen_ord"),
    )


def _slug_or_url() -> Column:
    return F.when(F.col("p_slug") != "", F.col("p_slug")).otherwise(F.col("url"))


def page_optimization(rows: DataFrame) -> DataFrame:
    """At most two fixes a page. ``rows`` are profiles with ``best_term`` and ``best_freq``."""
    c = F.col
    title, meta, url, best = c("p_title"), c("p_meta"), c("url"), c("best_term")
    missing = F.get(F.filter("slug_tokens", lambda t: ~F.array_contains("title_tokens", t) & ~F.array_contains("meta_tokens", t)), F.lit(0))
    confidence = F.least(
        F.lit(R.CONFIDENCE_MAX),
        16
        + F.when(c("is_indexable") == False, 0).otherwise(4)  # noqa: E712
        + F.when(F.coalesce("canonical_url", F.lit("")) != "", 4).otherwise(0)
        + F.when(title != "", 3).otherwise(0)
        + F.when(meta != "", 3).otherwise(0),
    )
    relevance = _relevance(c("best_freq"), 5)
    n = F.length(title)
    base = {"relevance": relevance, "confidence": confidence}
    rules = [
        {
            "when": title == "",
            "query": F.coalesce(best, _slug_or_url()),
            "impact": 18 + F.when(missing.isNotNull(), 4).otherwise(0),
            "reason": F.concat(url, F.lit(" has no title tag.")),
            "action": F.lit(f"Write a descriptive title ({R.TITLE_MIN}-{R.TITLE_MAX} characters) for this page."),
            "phrase": _slug_or_url(),
        },
        {
            "when": (title != "") & ((n < R.TITLE_MIN) | (n > R.TITLE_MAX)),
            "query": F.coalesce(best, title),
            "impact": F.lit(18),
            "reason": F.format_string(f"The title of %s is %d characters (recommended {R.TITLE_MIN}-{R.TITLE_MAX}).", url, n),
            "action": F.lit("Rewrite the title to the recommended length while keeping the page's primary topic."),
            "phrase": title,
        },
        {
            "when": meta == "",
            "query": F.coalesce(best, F.when(title != "", title).otherwise(url)),
            "impact": F.lit(16),
            "reason": F.concat(url, F.lit(" is missing a meta description.")),
            "action": F.lit("Add a descriptive meta description that summarises the page's topic."),
            "phrase": F.when(title != "", title).otherwise(_slug_or_url()),
        },
        {
            "when": (meta != "") & (F.length(meta) < R.META_MIN),
            "query": F.coalesce(best, title),
            "impact": F.lit(14),
            "reason": F.format_string(f"The meta description of %s is only %d characters (recommended at least {R.META_MIN}).", url, F.length(meta)),
            "action": F.lit("Expand the meta description to a full, descriptive sentence."),
            "phrase": title,
        },
        {
            "when": missing.isNotNull(),
            "query": F.coalesce(best, missing),
            "impact": F.lit(14),
            "reason": F.format_string('The URL of %s targets "%s" but the title and meta description do not mention it.', url, missing),
            "action": F.format_string('Align the title and meta description with the "%s" topic in the URL.', missing),
            "phrase": missing,
        },
    ]
    return _page_row(rows, "EXISTING_PAGE_OPTIMIZATION", [base | r for r in rules], 2, 2)


def search_intent_gap(rows: DataFrame) -> DataFrame:
    """Titles that promise an intent which a thin or undescribed page may not satisfy."""
    title, meta, freq = F.col("p_title"), F.col("p_meta"), F.col("best_freq")
    words = F.coalesce("word_count", F.lit(0))
    modifier = F.get(F.filter(R.literals(R.INTENT_MODIFIERS), lambda m: F.contains(F.lower(title), m)), F.lit(0))
    rule = {
        "when": (title != "") & ~is_utility_page(F.col("url")) & modifier.isNotNull() & ((words < R.INTENT_PAGE_WORDS) | (meta == "")),
        "query": title,
        "relevance": _relevance(freq, 8),
        "impact": 12 + F.when(words < 200, 10).otherwise(6) + F.when(meta == "", 4).otherwise(0),
        "confidence": F.least(F.lit(R.CONFIDENCE_MAX), 16 + F.when(freq.isNull(), 3).otherwise(3 * freq)),
        "reason": F.concat(
            F.format_string('"%s" suggests an informational intent ("%s") but the page is thin (%d words', title, modifier, words), F.when(meta == "", F.lit(" and has no meta description).")).otherwise(F.lit(")."))
        ),
        "action": F.format_string('Expand the page to fully satisfy "%s" search intent with structured, in-depth content.', modifier),
        "phrase": title,
    }
    return _page_row(rows, "SEARCH_INTENT_GAP", [rule], 3, 1)


def orphan_pages(rows: DataFrame) -> DataFrame:
    """Content pages that no content page links to, in crawls with more than one content page."""
    linked = rows.select("crawl_run_id", F.explode("internal_links").alias("url")).distinct()
    alone = rows.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).where("n = 1").drop("n")
    orphans = rows.join(linked, ["crawl_run_id", "url"], "left_anti").join(alone, ["crawl_run_id", "url"], "left_anti")
    freq = F.col("best_freq")
    rule = {
        "when": F.lit(True),
        "query": F.coalesce("best_term", _slug_or_url()),
        "relevance": _relevance(freq, 5),
        "impact": F.lit(22),
        "confidence": F.least(F.lit(R.CONFIDENCE_MAX), 20 + F.when(freq.isNull(), 0).otherwise(4 * F.least(freq, F.lit(4)))),
        "reason": F.concat("url", F.lit(" is not linked from any other page on the site.")),
        "action": F.lit("Add contextual internal links to this page from related pages."),
        "phrase": _slug_or_url(),
    }
    return _page_row(orphans, "INTERNAL_LINK_OPPORTUNITY", [rule], 4, 1)


def unlinked_topic_pairs(profiles: DataFrame, on_pages: DataFrame, core: DataFrame, most: int = 2) -> DataFrame:
    """The first pairs of pages dedicated to the same core topic that don't link each other.

    A page is open if it has fewer linked partners than its topic has other pages, which needs counts
    only. An open page's unlinked partner is open too, so the first 2 * ``most`` open pages of a crawl
    start ``most`` pairs at least (or all there are), and any other pair comes later: only these pages
    meet all pages of their topic.
    """
    topic = ["crawl_run_id", "term"]
    facts = profiles.select("crawl_run_id", "page_id", "url", "internal_links")
    own = on_pages.where("dedicated").join(core.where("dedicated_pages >= 2").select(*topic, "doc_freq", "topic_rank"), topic)
    side = own.join(facts, ["crawl_run_id", "page_id"]).select(*topic, "doc_freq", "topic_rank", F.struct("page_seq", "page_id").alias("i"), F.struct("page_id", "url").alias("a"), "internal_links")
    to = side.select(*topic, F.col("i").alias("j"), F.col("a.url").alias("url"))
    linked = side.select(*topic, "i", F.explode("internal_links").alias("url")).join(to, [*topic, "url"]).where("i != j").select(*topic, "i", "j")
    linked = linked.union(linked.select(*topic, "j", "i")).distinct()
    partners = linked.groupBy(*topic, "i").agg(F.count(F.lit(1)).alias("linked"))
    sizes = side.groupBy(*topic).agg(F.count(F.lit(1)).alias("pages"))
    starts = side.drop("internal_links").join(partners, [*topic, "i"], "left").join(sizes, topic).where("pages - 1 > coalesce(linked, 0)")
    nth = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("topic_rank", "i"))
    starts = starts.withColumn("k", nth).where(F.col("k") <= 2 * most).drop("k", "linked", "pages")
    pairs = starts.join(side.select(*topic, F.col("i").alias("j"), F.col("a").alias("b")), topic).where("i < j").join(linked, [*topic, "i", "j"], "left_anti")
    first = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("topic_rank", "i", "j"))
    pairs = pairs.withColumn("k", first).where(F.col("k") <= most)
    df = F.col("doc_freq")
    return pairs.select(
        "crawl_run_id",
        F.col("term").alias("query"),
        F.lit("INTERNAL_LINK_OPPORTUNITY").alias("opportunity_type"),
        _relevance(df, 5).alias("relevance"),
        (16 + F.when(df >= 3, 4).otherwise(0)).alias("impact"),
        F.least(F.lit(R.CONFIDENCE_MAX), 12 + 4 * F.least(df, F.lit(4))).alias("confidence"),
        F.format_string('%s and %s both cover "%s" but do not link to each other.', F.col("a.url"), F.col("b.url"), F.col("term")).alias("reason"),
        F.format_string("Add contextual internal links between %s and %s.", F.col("a.url"), F.col("b.url")).alias("suggested_action"),
        F.col("a.page_id").alias("related_page_id"),
        F.col("a.url").alias("related_page_url"),
        F.array(*[F.struct(F.col(f"{x}.url").alias("url"), F.col(f"{x}.page_id").alias("id")) for x in "ab"]).alias("evidence_pages"),
        F.array("term").alias("evidence_phrases"),
        _order(5, F.col("k")).alias("gen_ord"),
    )


#: What opportunities need of a profile.
PROFILE = ["crawl_run_id", "page_id", "page_seq", "url", "word_count", "internal_links", "is_indexable", "canonical_url", "p_title", "p_meta", "p_slug", "title_tokens", "meta_tokens", "slug_tokens", "all_tokens"]


def _candidates(profiles: DataFrame) -> dict[str, DataFrame]:
    on_pages = cut_lineage(topic_pages(profiles))
    core = cut_lineage(core_topics(extract_topics(on_pages)))
    rows = cut_lineage(profiles.join(best_topics(profiles, core), ["crawl_run_id", "page_id"], "left"))
    kinds = {
        "topics": topic_opportunities(profiles, on_pages, core),
        "page_optimization": page_optimization(rows),
        "search_intent_gap": search_intent_gap(rows),
        "orphan_pages": orphan_pages(rows),
        "unlinked_topic_pairs": unlinked_topic_pairs(profiles, on_pages, core),
    }
    return {k: scored(v) for k, v in kinds.items()}


def all_candidates(pages: DataFrame) -> dict[str, DataFrame]:
    """Every kind of opportunity before any cap, each scored. The pages are read once."""
    return _candidates(cut_lineage(page_profiles(pages).select(*PROFILE)))


def rank_opportunities(pages: DataFrame) -> DataFrame:
    """The kept opportunities of every crawl: duplicates out, at most four of a type, best twelve.

    The pages are read once, and the result is kept: it has at most twelve rows a crawl.
    """
    profiles = cut_lineage(page_profiles(pages).select(*PROFILE))
    parts = list(_candidates(profiles).values())
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    same = Window.partitionBy("crawl_run_id", "opportunity_type", F.lower("query"), F.coalesce("related_page_url", F.lit("")), "reason").orderBy("gen_ord")
    of_type = Window.partitionBy("crawl_run_id", "opportunity_type").orderBy("gen_ord")
    best = Window.partitionBy("crawl_run_id").orderBy(F.desc("score"), "query", "gen_ord")
    unique = union.withColumn("n", F.row_number().over(same)).where("n = 1")
    capped = unique.withColumn("n", F.row_number().over(of_type)).where(F.col("n") <= R.PER_TYPE)
    ranked = capped.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= R.PER_CRAWL).drop("n")
    with_brand = ranked.join(brands_of(profiles), "crawl_run_id", "left")
    out = with_brand.withColumn("intent", R.classify_intent(F.col("query"), F.col("brand"))).drop("brand", "gen_ord")
    return cut_lineage(out.withColumn("opportunity_id", F.sha2(F.concat_ws("|", "crawl_run_id", F.col("rank").cast("string")), 256)))


def opportunity_aggregate(opportunities: DataFrame) -> DataFrame:
    """(crawl_run_id, kind, key, n): counts by priority, type, intent and coverage, from one pass."""
    keys = {"priority": "priority", "type": "opportunity_type", "intent": "intent", "coverage": "coverage"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in keys.items()]))
    return opportunities.select("crawl_run_id", pairs.alias("p")).groupBy("crawl_run_id", "p.kind", "p.key").agg(F.count(F.lit(1)).alias("n"))


def entitled_top_k(opportunities: DataFrame, crawl_plans: DataFrame, free: int = 3) -> DataFrame:
    """All of a pro owner's opportunities, the best three of a free owner's. ``crawl_plans``: (crawl_run_id, plan)."""
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("score"), "query", "opportunity_id"))
    rows = opportunities.withColumn("place", place).join(crawl_plans, "crawl_run_id", "left")
    return rows.where(F.col("plan").eqNullSafe("pro") | (F.col("place") <= free)).drop("plan")


def action_roadmap(opportunities: DataFrame, most: int = 10) -> DataFrame:
    """The next steps: by priority, then score; each to improve, create or connect."""
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(R.priority_rank(F.col("priority")), F.desc("score"), "query", "opportunity_id"))
    t = F.col("opportunity_type")
    improve = t.isin("EXISTING_PAGE_OPTIMIZATION", "WEAK_TOPIC_COVERAGE")
    bucket = F.when(t == "CONTENT_GAP", "create").when(t == "INTERNAL_LINK_OPPORTUNITY", "connect").when(improve, "improve")
    return opportunities.withColumn("step", place).where(F.col("step") <= most).select("crawl_run_id", "step", "query", "opportunity_type", "priority", "score", bucket.alias("bucket"))
