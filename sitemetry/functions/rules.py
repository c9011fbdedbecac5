"""Severities, intents, priorities and labels: the fixed decisions of the audit and the planner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity of each finding, in the order in which reports list them.
SEVERITY = {
    "MISSING_TITLE": "error",
    "DUPLICATE_TITLE": "warning",
    "TITLE_TOO_SHORT": "warning",
    "TITLE_TOO_LONG": "warning",
    "MISSING_META_DESCRIPTION": "error",
    "DUPLICATE_META_DESCRIPTION": "warning",
    "MISSING_CANONICAL": "warning",
    "BROKEN_INTERNAL_LINK": "error",
    "NON_200_PAGE": "warning",
    "NOINDEX_PAGE": "warning",
    "MISSING_ROBOTS_TXT": "warning",
    "MISSING_SITEMAP": "warning",
    "MISSING_HTTPS": "error",
    "MISSING_H1": "error",
    "DUPLICATE_H1": "warning",
    "MULTIPLE_H1": "warning",
    "IMAGES_MISSING_ALT": "warning",
    "MISSING_OG_TAGS": "warning",
    "MISSING_TWITTER_TAGS": "info",
    "MISSING_VIEWPORT": "warning",
    "MISSING_CHARSET": "info",
    "MISSING_FAVICON": "info",
    "MISSING_HTML_LANG": "info",
    "THIN_CONTENT": "warning",
    "SLOW_RESPONSE": "warning",
}

TITLE_MIN, TITLE_MAX, META_MIN, THIN_WORDS, SLOW_MS = 30, 60, 50, 300, 3000
WEAK_COVERAGE_WORDS, INTENT_PAGE_WORDS, CORE_TOPIC_PAGES = 800, 400, 2
RELEVANCE_MAX, IMPACT_MAX, CONFIDENCE_MAX = 40, 30, 30
HIGH_FROM, MEDIUM_FROM = 70, 40
PER_TYPE, PER_CRAWL = 4, 12

# Words by the search intent they show, and words of a title that promise one.
COMMERCIAL_WORDS = [
    "best", "top", "review", "reviews", "alternative", "alternatives", "vs", "versus", "compare", "comparison", "cheap", "affordable",
    "recommendation", "recommendations", "rating", "ratings", "list",
]
COMMERCIAL_PHRASES = ["for beginners"]
TRANSACTIONAL_WORDS = [
    "calculator", "checker", "tool", "tools", "builder", "generator", "maker", "creator", "tracker", "converter", "finder", "pricing", "price",
    "prices", "cost", "costs", "buy", "purchase", "order", "subscription", "trial", "download", "signup", "coupon", "discount", "invoice", "estimate",
    "quote", "template", "templates", "rate", "rates", "free",
]
INTENT_MODIFIERS = [
    "best", "how to", "guide", "vs", "versus", "compare", "comparison", "top", "review", "reviews", "template", "calculator", "checker", "free", "tool", "tools", "examples", "example",
    "near me", "tips", "list", "cost", "price", "cheap", "alternative", "alternatives", "recommendation", "recommendations", "for beginners", "step by step", "step-by-step",
]


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_html(content_type: Column) -> Column:
    return F.coalesce(F.contains(content_type, F.lit("text/html")) | F.contains(content_type, F.lit("application/xhtml+xml")), F.lit(False))


def is_content_page(status: Column, content_type: Column) -> Column:
    return F.coalesce(status == 200, F.lit(False)) & is_html(content_type)


def is_broken(status: Column) -> Column:
    return F.coalesce((status == 0) | (status >= 400), F.lit(False))


def classify_intent(query: Column, brand: Column) -> Column:
    """navigational, then commercial, then transactional words; informational otherwise."""
    phrase = F.lower(F.trim(query))
    compact = F.regexp_replace(phrase, "[^a-z0-9]", "")
    words = F.split(phrase, "[^a-z0-9]+")
    named = F.coalesce((F.length(compact) >= 4) & (compact == F.regexp_replace(F.lower(brand), "[^a-z0-9]", "")), F.lit(False))
    compares = F.arrays_overlap(words, literals(COMMERCIAL_WORDS))
    for p in COMMERCIAL_PHRASES:
        compares = compares | F.contains(phrase, F.lit(p))
    return F.when(named, "navigational").when(compares, "commercial").when(F.arrays_overlap(words, literals(TRANSACTIONAL_WORDS)), "transactional").otherwise("informational")


def coverage_for_type(opportunity_type: Column) -> Column:
    return F.when(opportunity_type == "CONTENT_GAP", "GAP").otherwise("IMPROVEMENT")


def priority_of(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, "high").when(score >= MEDIUM_FROM, "medium").otherwise("low")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)


def health_label(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Healthy").when(score >= 60, "Good").when(score >= 40, "Needs Fixes").otherwise("Critical")


def visibility_label(score: Column) -> Column:
    return F.when(score >= 60, "Strong").when(score >= 40, "Moderate").when(score >= 25, "Low").otherwise("Very Low")
