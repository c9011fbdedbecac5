"""Text normalisation, tokens and phrases as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name no topic (function words, then words of site furniture).
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "for", "with", "from", "by", "at", "as", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "not",
    "no", "nor", "so", "yet", "than", "then", "that", "this", "these", "those", "there", "here", "when", "where", "which", "who", "whom", "whose",
    "what", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "very", "just", "too",
    "also", "even", "still", "until", "while", "about", "above", "below", "under", "over", "through", "during", "before", "after", "again", "further",
    "once", "off", "out", "up", "down", "into", "onto", "upon", "within", "without", "between", "among", "across", "against", "because", "every",
    "together", "page", "pages", "site", "website", "web", "home", "index", "content", "article", "articles", "blog", "read", "learn", "info",
    "information", "click", "link", "links", "view", "visit", "www", "http", "https", "com", "html", "php", "aspx", "default", "main", "contact",
    "privacy", "terms", "login", "register", "signup", "sign", "news", "latest", "menu", "footer", "header", "search", "results", "result", "items",
    "item", "list", "lists", "category", "categories", "tag", "tags", "archive", "archives",
]

#: White space as JavaScript and the reference's databases see it, for the characters that occur in page text.
SPACE = r"[\s ﻿]"

TOPIC_TOKEN_CHARS, DISCUSSION_TOKEN_CHARS = 4, 3


def js_trim(value: Column) -> Column:
    """Trim all white space, not only U+0020."""
    return F.regexp_replace(value, rf"^{SPACE}+|{SPACE}+$", "")


def text_or_empty(value: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(js_trim(value), F.lit(""))


def words_only(value: Column) -> Column:
    """Lower case with everything but a-z, 0-9 and hyphens turned into single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def tokens(value: Column, least: int, stopwords: list[str] = STOPWORDS) -> Column:
    """Words of at least ``least`` characters that are neither numbers nor stopwords, in order."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(
        F.split(words_only(F.coalesce(value, F.lit(""))), r"\s+"),
        lambda t: (F.length(t) >= least) & ~t.rlike("^[0-9]+$") & ~F.array_contains(stop, t),
    )


def significant_tokens(value: Column) -> Column:
    return tokens(value, TOPIC_TOKEN_CHARS)


def discussion_tokens(value: Column) -> Column:
    return tokens(value, DISCUSSION_TOKEN_CHARS)


def bigrams(words: Column) -> Column:
    """Adjacent pairs joined by a space; empty for fewer than two words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(pairs)


def term_candidates(words: Column) -> Column:
    """The words, then their adjacent pairs."""
    return F.concat(words, bigrams(words))


def normalize_query(value: Column) -> Column:
    """Lower case, with runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def query_tokens(value: Column) -> Column:
    return F.filter(F.split(normalize_query(F.coalesce(value, F.lit(""))), " "), lambda t: t != "")


def capitalized(value: Column) -> Column:
    """Collapsed phrase with its first letter in upper case."""
    phrase = F.regexp_replace(F.trim(value), r"\s+", " ")
    return F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, F.lit(2), F.length(phrase)))


def js_round(value: Column) -> Column:
    """Rounding with halves upwards, as an integer."""
    return F.floor(value + F.lit(0.5)).cast("int")


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(value)))
