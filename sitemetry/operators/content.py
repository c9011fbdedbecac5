"""Content planning: seeds from four sources, briefs, clusters and counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import CORE_TOPIC_PAGES, priority_rank
from ..functions.text import capitalized, text_or_empty
from ..functions.urls import link_key, slug_phrase
from ..sources.tables import cut_lineage, measured
from .visibility import planner_topic

PLAN_LENGTH = 6
# Order of sources in the plan, and each source's search intent.
SOURCE_ORDER = ["CONTENT_GAP", "SEARCH_INTENT_GAP", "WEAK_TOPIC_COVERAGE", "AI_VISIBILITY_GAP", "CORE_TOPIC", "SEO_FIX"]
INTENT = {
    "CONTENT_GAP": "informational",
    "SEARCH_INTENT_GAP": "commercial",
    "WEAK_TOPIC_COVERAGE": "informational",
    "SEO_FIX": "on-page",
    "CORE_TOPIC": "informational",
    "AI_VISIBILITY_GAP": "commercial",
}
COPY_ISSUES = ["MISSING_TITLE", "TITLE_TOO_SHORT", "MISSING_META_DESCRIPTION"]


def outline_for_intent(intent: Column, topic: Column) -> Column:
    line = lambda before, after="": F.concat(F.lit(before), topic, F.lit(after))
    lower = F.lower(intent)
    fixed = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    return (
        F.when(F.contains(lower, F.lit("commercial")), fixed("Introduction", line("Why ", " matters"), "Comparison of options", "Recommendations", "Summary and next steps"))
        .when(F.contains(lower, F.lit("transactional")), fixed("Introduction", line("Features of "), "Pricing and options", "Frequently asked questions", "Get started"))
        .when(F.contains(lower, F.lit("on-page")), fixed(line("Overview of "), "Key points to communicate", "Suggested heading structure", "Meta description and title rewrite"))
        .otherwise(fixed("Introduction", line("What is "), line("Common questions about "), line("How to use ", " effectively"), "Summary and next steps"))
    )


def content_seeds(pages: DataFrame, opportunities: DataFrame, issues: DataFrame, topics: DataFrame, answers: DataFrame) -> DataFrame:
    """(crawl_run_id, topic, source_type, priority, rationale, seed_ord, reference) of the four sources."""
    order = lambda source, *at: F.struct(F.lit(source).alias("source"), *[c.alias(f"o{i}") for i, c in enumerate(at)])
    none = F.lit("")
    found = opportunities.where(F.col("opportunity_type").isin("CONTENT_GAP", "SEARCH_INTENT_GAP", "WEAK_TOPIC_COVERAGE")).select(
        "crawl_run_id",
        F.col("query").alias("topic"),
        F.col("opportunity_type").alias("source_type"),
        "priority",
        F.concat_ws(" ", "reason", "suggested_action").alias("rationale"),
        order(1, F.col("score").cast("bigint"), F.col("opportunity_id")).alias("seed_ord"),
        F.format_string('Search opportunity "%s" (%s, priority %s): %s', "query", "opportunity_type", "priority", "reason").alias("reference"),
    )
    copy = issues.where(F.col("page_id").isNotNull() & F.col("issue_type").isin(*COPY_ISSUES))
    place = F.array_position(F.array(*[F.lit(x) for x in COPY_ISSUES]), F.col("issue_type"))
    per_page = copy.groupBy("crawl_run_id", "page_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("k"), "issue_type", "severity"))).alias("i"))
    title, slug = text_or_empty(F.col("title")), slug_phrase(F.col("url"))
    severity = F.get("i", F.lit(0))["severity"]
    fixes = per_page.join(pages.select("crawl_run_id", "page_id", "page_seq", "url", "title"), ["crawl_run_id", "page_id"]).select(
        "crawl_run_id",
        F.when(title != "", title).when(slug != "", slug).otherwise(F.col("url")).alias("topic"),
        F.lit("SEO_FIX").alias("source_type"),
        F.when(severity == "error", "high").when(severity == "warning", "medium").otherwise("low").alias("priority"),
        F.concat("url", F.lit(" has content issues: "), F.array_join("i.issue_type", "; "), F.lit(".")).alias("rationale"),
        order(2, F.col("page_seq"), none).alias("seed_ord"),
        F.concat(F.lit("Page "), "url", F.lit(" ("), F.array_join("i.issue_type", "; "), F.lit(")")).alias("reference"),
    )
    core = topics.where((F.col("doc_freq") >= CORE_TOPIC_PAGES) & (F.col("dedicated_pages") == 0)).select(
        "crawl_run_id",
        F.col("term").alias("topic"),
        F.lit("CORE_TOPIC").alias("source_type"),
        F.lit("medium").alias("priority"),
        F.format_string('Topic "%s" appears across %d pages but no page targets it directly.', "term", "doc_freq").alias("rationale"),
        order(3, -F.col("doc_freq"), F.col("term")).alias("seed_ord"),
        F.format_string('Core topic "%s" referenced on %d pages, no dedicated page', "term", "doc_freq").alias("reference"),
    )
    asked = planner_topic(F.col("prompt"))
    gaps = answers.where(~F.col("mentioned")).select(
        "crawl_run_id",
        asked.alias("topic"),
        F.lit("AI_VISIBILITY_GAP").alias("source_type"),
        F.lit("high").alias("priority"),
        F.format_string('The AI provider did not mention the site when asked about "%s". Publish content on this topic to earn AI citations.', asked).alias("rationale"),
        order(4, F.lit(0).cast("bigint"), F.col("prompt")).alias("seed_ord"),
        F.format_string('AI visibility gap: provider answered "%s" without mentioning the site', asked).alias("reference"),
    )
    return found.unionByName(fixes).unionByName(core).unionByName(gaps)


def plan_content(seeds: DataFrame, most: int = PLAN_LENGTH) -> DataFrame:
    """The plan of each crawl: the earliest source of a topic, by priority, source and topic, at most six."""
    key = F.lower(F.trim("topic"))
    first = F.row_number().over(Window.partitionBy("crawl_run_id", "__key").orderBy("seed_ord"))
    source = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source_type"))
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(priority_rank(F.col("priority")), source, "topic"))
    unique = seeds.withColumn("__key", key).where("length(__key) >= 3").withColumn("__n", first).where("__n = 1")
    intent = F.element_at(F.create_map(*[F.lit(x) for kv in INTENT.items() for x in kv]), F.col("source_type"))
    return unique.withColumn("place", place).where(F.col("place") <= most).select("crawl_run_id", "place", "topic", "source_type", "priority", intent.alias("intent"), "rationale", "reference")


def plan_briefs(plan: DataFrame, parsed: DataFrame) -> DataFrame:
    """Plan rows with title, intent and outline; an answer's where one was parsed (topic, title, intent, structure)."""
    p = parsed.select("crawl_run_id", "topic", F.col("title").alias("__t"), F.col("intent").alias("__i"), F.col("structure").alias("__s"))
    rows = plan.join(p, ["crawl_run_id", "topic"], "left")
    outline = F.when(F.size("__s") > 0, F.col("__s")).otherwise(outline_for_intent(F.col("intent"), F.col("topic")))
    return rows.select("crawl_run_id", "place", "topic", F.coalesce("__t", capitalized(F.col("topic"))).alias("title"), F.coalesce("__i", "intent").alias("intent"), outline.alias("structure"), F.col("__t").isNotNull().alias("ai_enhanced"))


def opportunity_brief(opportunities: DataFrame) -> DataFrame:
    """One brief for each opportunity, from its own data only."""
    query = F.col("query")
    angle = F.when(F.col("coverage") == "GAP", F.format_string('Publish new, dedicated coverage that directly targets "%s" from scratch.', query)).otherwise(
        F.format_string('Improve and expand the existing coverage of "%s" so it fully satisfies the search intent.', query)
    )
    phrases = F.filter("evidence_phrases", lambda p: F.trim(p) != "")
    points = F.when(F.size(phrases) > 0, phrases).otherwise(F.array(F.format_string('Answer what "%s" is and why it matters to the reader.', query)))
    return opportunities.select(
        "crawl_run_id",
        "opportunity_id",
        query.alias("target_topic"),
        F.col("intent").alias("search_intent"),
        "coverage",
        F.col("reason").alias("opportunity"),
        "suggested_action",
        F.filter(F.transform("evidence_pages", lambda p: p["url"]), lambda u: u != "").alias("evidence_page_urls"),
        phrases.alias("evidence_phrases"),
        angle.alias("angle"),
        capitalized(query).alias("suggested_title"),
        outline_for_intent(F.col("intent"), query).alias("structure"),
        points.alias("key_points"),
        F.lit(False).alias("ai_enhanced"),
    )


def _lines(*lines: Column | str) -> Column:
    """Lines joined by line feeds; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])


# The wording of the prompts.
def plan_prompt(topic: Column, reference: Column, intent: Column, domain: Column) -> Column:
    """What to ask for a brief of a planned topic."""
    return _lines(
        F.concat(F.lit("You are an SEO content strategist for the website "), domain, F.lit(".")),
        F.concat(F.lit('Derived from a real crawl, this topic is relevant: "'), topic, F.lit('".')),
        F.concat(F.lit("Evidence: "), reference, F.lit(".")),
        F.concat(F.lit("Target intent: "), intent, F.lit(".")),
        "Write a short content brief with exactly three labelled parts:",
        "TITLE: one concrete article title under 70 characters.",
        "INTENT: the primary intent the page should satisfy.",
        "STRUCTURE: a 3-6 point bullet outline (H2 sections) with a short phrase per point.",
        "Base everything only on the provided evidence. Do not invent metrics such as search volume, CPC, rankings or traffic.",
    )


def brief_prompt(domain: Column) -> Column:
    """What to ask for an enhanced brief, from a row of ``opportunity_brief``."""
    told = lambda before, column, after="": F.concat(F.lit(before), F.col(column), F.lit(after))
    listed = lambda before, column, between: F.when(F.size(column) > 0, F.concat(F.lit(before), F.array_join(column, between)))
    return _lines(
        F.concat(F.lit("You are an SEO content strategist for the website "), domain, F.lit(".")),
        told('Target search query: "', "target_topic", '".'),
        told("Search intent to satisfy: ", "search_intent", "."),
        told("Coverage state: ", "coverage", "."),
        told("Why this is an opportunity: ", "opportunity"),
        told("Suggested action: ", "suggested_action"),
        listed("Existing evidence pages: ", "evidence_page_urls", ", "),
        listed("Phrases from real content to address: ", "evidence_phrases", "; "),
        "Write a concise content brief with exactly four labelled parts:",
        "ANGLE: one recommended content angle in a single sentence.",
        "TITLE: one concrete article title under 70 characters.",
        "STRUCTURE: a 3-6 point bullet outline (H2 sections) with a short phrase per point.",
        "KEY_POINTS: a 2-4 point bullet list of key points the article must address.",
        "Ground everything in the provided evidence. Do not invent search volume, keyword difficulty, CPC, rankings, traffic or any other unsupported metric.",
    )


def draft_prompt(domain: Column) -> Column:
    """What to ask for a draft article, from a row of ``opportunity_brief``, enhanced or not."""
    told = lambda before, column, after="": F.concat(F.lit(before), F.col(column), F.lit(after))
    numbered = F.transform("structure", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return _lines(
        F.concat(F.lit("You are writing a draft article for the website "), domain, F.lit(".")),
        told('Target search query: "', "target_topic", '".'),
        told("Search intent to satisfy: ", "search_intent", "."),
        told("Recommended angle: ", "angle"),
        told("Suggested title: ", "suggested_title"),
        F.concat(F.lit("Use this structure: "), F.array_join(numbered, " ")),
        F.concat(F.lit("Key points the article must address: "), F.array_join(F.transform("key_points", lambda x: F.concat(F.lit("- "), x)), " ")),
        "Write a complete, useful draft article in Markdown with H1 and H2 headings that follows this structure.",
        "The article must be genuinely helpful to a real reader and must not stuff keywords.",
        "Do not invent statistics, studies, prices, dates or any facts that were not provided. Where a claim needs verification, write it in a neutral way or flag it as needing review.",
        "End the draft with a short italic note: this is an AI-generated draft that requires human review before publication.",
    )


def apply_brief_enhancement(briefs: DataFrame, parsed: DataFrame) -> DataFrame:
    """Briefs overlaid with an answer's non-empty angle, title, structure and key points; the rest never changes."""
    p = parsed.select("opportunity_id", F.col("angle").alias("__a"), F.col("title").alias("__t"), F.col("structure").alias("__s"), F.col("key_points").alias("__k"))
    rows = briefs.join(p, "opportunity_id", "left")
    text = lambda new, old: F.coalesce(F.nullif(F.trim(new), F.lit("")), old)
    items = lambda new, old: F.when(F.size(new) > 0, F.col(new)).otherwise(F.col(old))
    changed = {"angle": text("__a", "angle"), "suggested_title": text("__t", "suggested_title"), "structure": items("__s", "structure"), "key_points": items("__k", "key_points"), "ai_enhanced": F.col("__t").isNotNull()}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in briefs.columns])


_LABELS = "(?:ANGLE|TITLE|STRUCTURE|KEY_POINTS)"


def _bullets(block: Column, most: int) -> Column:
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*•0-9.)\s]+", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def parse_brief_text(text: Column) -> Column:
    """Struct (title, intent, structure) of a labelled answer; null without a title."""
    title = F.trim(F.regexp_extract(text, r"(?im)^TITLE:\s*(.+)$", 1))
    intent = F.trim(F.regexp_extract(text, r"(?im)^INTENT:\s*(.+)$", 1))
    block = F.regexp_extract(text, r"(?im)^STRUCTURE:\s*([\s\S]+)", 1)
    return F.when(title != "", F.struct(title.alias("title"), F.when(intent == "", "informational").otherwise(intent).alias("intent"), _bullets(block, 6).alias("structure")))


def parse_enhancement_text(text: Column) -> Column:
    """Struct (angle, title, structure, key_points) of a labelled answer; null without a title."""
    line = lambda label: F.trim(F.regexp_extract(text, rf"(?im)^{label}:[ \t]*(.*)$", 1))
    block = lambda label: F.trim(F.regexp_extract(text, rf"(?im)^{label}:\s*([\s\S]*?)(?=^\s*{_LABELS}:|\z)", 1))
    title = line("TITLE")
    return F.when(title != "", F.struct(line("ANGLE").alias("angle"), title.alias("title"), _bullets(block("STRUCTURE"), 6).alias("structure"), _bullets(block("KEY_POINTS"), 4).alias("key_points")))


def content_action_counts(plan: DataFrame) -> DataFrame:
    """(crawl_run_id, action, n): what the plan asks for."""
    s = F.col("source_type")
    action = F.when(s.isin("SEARCH_INTENT_GAP", "WEAK_TOPIC_COVERAGE"), "Expand topic coverage").when(s == "SEO_FIX", "Improve existing page").otherwise("Create new content")
    return plan.groupBy("crawl_run_id", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def content_clusters(plan: DataFrame, most: int = 6) -> DataFrame:
    """(crawl_run_id, cluster, topics): greedy word buckets over a plan's topics, in plan order.

    A topic joins the first of its words that has a bucket, else opens one with its first word.
    Buckets depend on order, so a crawl's plan (at most six rows) is one group.
    """

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        buckets: dict[str, list[str]] = {}
        for topic in group.sort_values("place")["topic"]:
            words = [w for w in re.split("[^a-z0-9]+", topic.lower()) if len(w) > 3]
            home = next((w for w in words if w in buckets), words[0] if words else None)
            if home is not None:
                buckets.setdefault(home, []).append(topic)
        named: dict[str, tuple[str, list[str]]] = {}
        for word, topics in buckets.items():
            if len(topics) >= 2:
                named.setdefault("|".join(sorted(topics)), (word.capitalize(), topics))
        best = sorted(named.values(), key=lambda x: -len(x[1]))[:most]
        return pd.DataFrame({"crawl_run_id": [group["crawl_run_id"].iloc[0]] * len(best), "cluster": [b[0] for b in best], "topics": [b[1] for b in best]}, dtype=object)

    return plan.select("crawl_run_id", "place", "topic").groupBy("crawl_run_id").applyInPandas(cluster, "crawl_run_id string, cluster string, topics array<string>")


def content_link_suggestions(plan: DataFrame, pages: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(crawl_run_id, place, source, target, topic): pages of a planned topic that don't link each other.

    Texts are matched by an index of four letters: a topic's word is looked up by its first four (all
    such words are longer than three), so plan and pages meet on crawl and letters, and only those are
    searched for the word. The plan has at most six topics a crawl and is broadcast if measured small;
    the letters that any plan looks for number 36 to the 4 at most, so pages keep only these before they
    are dealt. Only the first eight pairs of a crawl are kept. As long as earlier topics have fewer than ``most`` pairs, the first
    2 * ``most`` of a topic hold enough new ones; these start at its first 4 * ``most`` pages with an
    unlinked partner (see ``unlinked_topic_pairs``), and only such pages meet all pages of the topic.
    """
    words = F.filter(F.split(F.lower("topic"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    topics = plan.select("crawl_run_id", F.col("place").alias("t"), "topic", words.alias("w"))
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), F.lower("url"))
    shown = pages.select("crawl_run_id", "page_seq", link_key(F.col("url")).alias("key"), text.alias("text"))
    looked_up = topics.withColumn("w", F.explode("w")).withColumn("four", F.substring("w", 1, 4)).distinct()
    looked_up = measured(looked_up, F.length("crawl_run_id") + F.length("topic") + F.length("w") + 40)
    fours = F.broadcast(looked_up.select("four").distinct())  # 36 ** 4 at most
    places = F.when(F.length("text") >= 4, F.sequence(F.lit(1), F.length("text") - 3))
    shown = shown.where("key is not null").withColumn("four", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("text"), i, F.lit(4)))))).join(fours, "four", "left_semi")
    hits = shown.join(looked_up, ["crawl_run_id", "four"]).where(F.contains("text", F.col("w")))
    group = ["crawl_run_id", "t"]
    hits = hits.groupBy(*group, "topic", "key").agg(F.min("page_seq").alias("seq"))
    hits = hits.select(*group, "topic", F.struct("seq", "key").alias("i"), F.col("key").alias("source"))
    hits = cut_lineage(hits)
    targets = hits.select(*group, F.col("i").alias("j"), F.col("source").alias("target"))
    both = edges.select("crawl_run_id", "source", "target").union(edges.select("crawl_run_id", "target", "source")).where("source != target").distinct()
    linked = both.join(hits.select(*group, "source"), ["crawl_run_id", "source"]).join(targets.drop("j"), [*group, "target"], "left_semi")
    partners = linked.groupBy(*group, "source").agg(F.count(F.lit(1)).alias("linked"))
    sizes = measured(hits.groupBy(*group).agg(F.count(F.lit(1)).alias("pages")), F.length("crawl_run_id") + 24)
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("i"))
    starts = hits.join(partners, [*group, "source"], "left").join(sizes, group).where("pages - 1 > coalesce(linked, 0)")
    starts = starts.withColumn("n", nth).where(F.col("n") <= 4 * most).drop("n", "linked", "pages")
    starts = measured(starts, F.length("crawl_run_id") + F.length("topic") + 2 * F.length("source") + 48)  # 4 * most a topic at most
    pairs = starts.join(targets, group).where("i < j")
    open_ = pairs.join(both, ["crawl_run_id", "source", "target"], "left_anti").withColumn("pair", F.sort_array(F.array("source", "target")))
    first = F.row_number().over(Window.partitionBy("crawl_run_id", "pair").orderBy("t", "i", "j"))
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("t", "i", "j"))
    once = open_.withColumn("k", first).where("k = 1").withColumn("place", place).where(F.col("place") <= most)
    return once.select("crawl_run_id", "place", "source", "target", "topic")
