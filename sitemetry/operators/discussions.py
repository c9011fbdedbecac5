"""Community discussions: scoring, ranking and roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import CORE_TOPIC_PAGES, is_content_page, literals, priority_of
from ..functions.text import bigrams, discussion_tokens, js_round, js_trim, significant_tokens
from ..functions.urls import slug_phrase
from ..sources.tables import measured

DISCUSSIONS_KEPT = 10
QUERIES_KEPT, TITLE_WORDS, SLUG_WORDS, PHRASE_CHARS = 8, 4, 5, 40

# Words too general to be a search by themselves.
GENERAL = [
    "tool", "tools", "guide", "guides", "app", "apps", "application", "applications", "website", "websites", "software", "business", "businesses",
    "company", "companies", "service", "services", "online", "free", "best", "top", "fast", "quick", "quickly", "simple", "easy", "help", "helpful",
    "info", "information", "example", "examples", "feature", "features", "function", "functions", "result", "results", "make", "making", "works",
    "working", "good", "great", "use", "used", "using", "calculator", "calculators", "calculate", "calculated", "calculating", "percentage",
    "percent", "amount", "amounts", "total", "totals", "splits", "choose", "copy", "round", "select", "enter", "input", "value", "values", "number",
    "numbers", "price", "prices", "rate", "rates", "solution", "solutions", "platform", "provider", "suite", "our", "your", "their", "ours", "theirs",
    "provide", "provides", "provided", "offer", "offers", "offered", "get", "gets", "got", "need", "needs", "want", "wants", "find", "finds", "helps",
    "various", "many", "stuff", "things", "thing", "one", "two", "three", "first", "second", "third", "like", "just", "really", "very", "also", "new",
    "old", "next", "last", "faq", "meta", "title", "description", "descriptive", "valid", "default", "generic", "sample", "placeholder",
]
SINGLE, BIGRAM, PHRASE, OPPORTUNITY = range(4)


def discussion_terms(pages: DataFrame, opportunities: DataFrame) -> DataFrame:
    """(crawl_run_id, term, tokens, doc_freq, dedicated, kind): what a crawl's discussions could be about.

    Words, pairs and short whole phrases of slugs (all pages) and of titles and descriptions (content
    pages), and the queries of three types of opportunities. A term seen as several kinds has the highest.
    """
    content = is_content_page(F.col("status_code"), F.col("content_type"))
    only = lambda c: F.when(content, F.coalesce(c, F.lit(""))).otherwise("")
    fields = [(slug_phrase(F.col("url")), True, 1, SLUG_WORDS), (only(F.col("title")), True, 2, TITLE_WORDS), (only(F.col("meta_description")), False, 1, 0)]
    rows = pages.select("crawl_run_id", "page_id", "page_seq", *[f.alias(f"f{i}") for i, (f, *_) in enumerate(fields)])
    rows = rows.select("*", *[discussion_tokens(F.col(f"f{i}")).alias(f"t{i}") for i in range(3)])

    def entry(term, tokens, dedicated: bool, kind: int, at: int):
        return F.struct(term.alias("term"), tokens.alias("tokens"), F.lit(dedicated).alias("dedicated"), F.lit(kind).alias("kind"), F.lit(at).alias("at"))

    def parts(terms, tokens_of, dedicated: bool, kind: int, at: int):
        return F.transform(terms, lambda x: entry(x, tokens_of(x), dedicated, kind, at))

    found = []
    for i, (_, dedicated, least, most) in enumerate(fields):
        t, phrase = F.col(f"t{i}"), F.lower(js_trim(F.col(f"f{i}")))
        fits = (F.size(t) >= least) & (F.size(t) <= most) & (F.length(phrase) <= PHRASE_CHARS)
        found.append(F.when(fits, F.array(entry(phrase, t, dedicated, PHRASE, 10 * i))).otherwise(F.array()))
        found.append(parts(t, F.array, dedicated, SINGLE, 10 * i + 1))
        found.append(parts(bigrams(t), lambda b: F.split(b, " "), dedicated, BIGRAM, 10 * i + 2))
    terms = rows.select("crawl_run_id", "page_id", "page_seq", F.explode(F.concat(*found)).alias("e")).select("crawl_run_id", "page_id", F.struct("page_seq", "e.at").alias("ord"), "e.term", "e.tokens", "e.dedicated", "e.kind")
    query = F.lower(F.trim("query"))
    asked = opportunities.where(F.col("opportunity_type").isin("CONTENT_GAP", "SEARCH_INTENT_GAP", "WEAK_TOPIC_COVERAGE")).select(
        "crawl_run_id", F.lit(None).cast("string").alias("page_id"), F.struct(F.lit(2**62).alias("page_seq"), F.lit(0).alias("at")).alias("ord"), query.alias("term"), discussion_tokens(query).alias("tokens"), F.lit(None).cast("boolean").alias("dedicated"), F.lit(OPPORTUNITY).alias("kind")
    )
    every = terms.where("length(term) >= 3").unionByName(asked.where("size(tokens) > 0"))
    per_page = every.groupBy("crawl_run_id", "term", "page_id").agg(F.bool_or("dedicated").alias("dedicated"), F.max("kind").alias("kind"), F.min_by("tokens", "ord").alias("tokens"), F.min("ord").alias("ord"))
    return per_page.groupBy("crawl_run_id", "term").agg(
        F.min_by("tokens", "ord").alias("tokens"), F.count("page_id").alias("doc_freq"), F.coalesce(F.bool_or("dedicated"), F.lit(True)).alias("dedicated"), F.max("kind").alias("kind")
    )


def _specific(tokens):
    return F.filter(tokens, lambda w: ~F.array_contains(literals(GENERAL), w))


def noise_filter(terms: DataFrame) -> DataFrame:
    """``terms`` without general ones, and without pairs that stand inside one of the crawl's phrases."""
    kept = terms.where(F.when(F.col("kind") == SINGLE, ~F.array_contains(literals(GENERAL), F.col("term"))).otherwise(F.size(_specific(F.col("tokens"))) > 0))
    inside = terms.where(F.col("kind") == PHRASE).select("crawl_run_id", F.explode(bigrams(F.col("tokens"))).alias("pair")).distinct().withColumn("kind", F.lit(BIGRAM))
    return kept.withColumn("pair", F.array_join("tokens", " ")).join(inside, ["crawl_run_id", "pair", "kind"], "left_anti").drop("pair")


def _term_scores(kept: DataFrame) -> DataFrame:
    clear = F.size(_specific(F.col("tokens"))) == F.size("tokens")
    general_first = F.array_contains(literals(GENERAL), F.get("tokens", F.lit(0)))
    kind = F.col("kind")
    specificity = (
        F.when(kind == OPPORTUNITY, 50)
        .when(kind == PHRASE, F.when(clear, 30).otherwise(15))
        .when(kind == BIGRAM, F.when(clear, 25).when(general_first, 5).otherwise(10))
        .otherwise(F.when(clear, 5).otherwise(0))
    )
    return kept.withColumn("term_score", 20 * F.col("doc_freq") + F.when(F.col("dedicated"), 10).otherwise(0) + specificity)


def rank_discussion_queries(kept: DataFrame, most: int = QUERIES_KEPT) -> DataFrame:
    """(crawl_run_id, query_ord, query, term_score, core): the searches of a crawl, best first."""
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("term_score"), "term"))
    ranked = _term_scores(kept).withColumn("query_ord", place).where(F.col("query_ord") <= most)
    return ranked.select("crawl_run_id", "query_ord", F.col("term").alias("query"), "term_score", (F.col("doc_freq") >= CORE_TOPIC_PAGES).alias("core"))


def core_discussion_terms(kept: DataFrame) -> DataFrame:
    """(crawl_run_id, term, term_score): every kept term of several pages; its place follows from score and term."""
    return _term_scores(kept.where(F.col("doc_freq") >= CORE_TOPIC_PAGES)).select("crawl_run_id", "term", "term_score")


def score_discussions(posts: DataFrame, core_terms: DataFrame, as_of: datetime) -> DataFrame:
    """``posts`` (crawl_run_id, query, title, body_snippet, author, score, num_comments, created_at, ...) with
    relevance, impact, confidence, opportunity_score, priority and reason.

    ``core_terms`` holds (crawl_run_id, term). Their words meet the posts' words on crawl and word, the
    crawls' words broadcast if they are measured small. A post travels with its first word and its words
    come together again under a hash of the whole post, so posts are read and dealt once; repeated
    posts are counted and repeated in the result.
    """
    told = posts.select(F.struct("*").alias("__p"), significant_tokens(F.col("title")).alias("__t"), significant_tokens(F.col("body_snippet")).alias("__b"), F.col("crawl_run_id"))
    told = told.select("__p", "__t", F.concat("__t", F.coalesce("__b", F.array().cast("array<string>"))).alias("__w"), "crawl_run_id", F.xxhash64("__p").alias("__h1"), F.xxhash64(F.lit(1), "__p").alias("__h2"))
    spoken = told.select("crawl_run_id", "__h1", "__h2", "__p", "__t", F.posexplode_outer("__w").alias("__at", "w"))
    first = F.coalesce(F.col("__at"), F.lit(0)) == 0
    spoken = spoken.select("crawl_run_id", "w", "__h1", "__h2", F.when(first, F.struct("__p", "__t")).alias("__post"))
    words = core_terms.select("crawl_run_id", F.explode(significant_tokens(F.col("term"))).alias("w")).distinct().withColumn("__core", F.lit(1))
    words = measured(words, F.length("crawl_run_id") + F.length("w") + 32)
    heard = spoken.join(words, ["crawl_run_id", "w"], "left").groupBy("__h1", "__h2").agg(F.first("__post", ignorenulls=True).alias("__post"), F.count("__post").alias("__copies"), F.count("__core").alias("__core"))
    rows = heard.select("__post.__p.*", F.col("__post.__t").alias("__t"), (F.col("__core") / F.col("__copies")).cast("bigint").alias("__core"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).alias("__copy"))
    rows = rows.withColumn("__q", significant_tokens(F.col("query")))
    hit = F.size(F.filter("__q", lambda w: F.array_contains("__t", w)))
    match = F.when(F.size("__q") == 0, 0.0).otherwise(hit / F.size("__q"))
    core = F.coalesce("__core", F.lit(0))
    relevance = js_round(F.least(F.lit(40.0), 8 + 12 * match + 3 * F.least(core, F.lit(6))))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("created_at")) / 86400)
    dated = F.col("created_at").isNotNull()  # greatest() passes over nulls
    fresh = F.when(dated & (age < 30), 5).when(dated & (age < 180), 3).otherwise(0)
    talk = F.least(F.lit(1.0), F.log2(F.col("num_comments") + 1) / 5)
    points = F.least(F.lit(1.0), F.log10(F.col("score") + 1) / 3)
    impact = js_round(F.least(F.lit(30.0), talk * 15 + points * 10 + fresh))
    given = lambda c, n: F.when(F.col(c).isNotNull(), n).otherwise(0)
    confidence = F.least(F.lit(30), 10 + F.when(F.length("title") >= 15, 6).otherwise(0) + given("author", 5) + given("body_snippet", 6) + given("created_at", 4))
    rows = rows.withColumn("relevance", relevance).withColumn("impact", impact).withColumn("confidence", confidence)
    rows = rows.withColumn("opportunity_score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("relevance") + F.col("impact") + F.col("confidence"))))
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    days = F.when(F.col("created_at").isNotNull(), F.concat(F.lit(" · "), many(js_round(age), "day"), F.lit(" old"))).otherwise("")
    reason = F.concat(
        F.lit('"'), "title", F.lit('" in r/'), "subreddit", F.lit(" ("), many(F.col("num_comments"), "comment"), F.lit(" · "), many(F.col("score"), "point"), days, F.lit(') relates to topic "'), "query", F.lit('".')
    )
    return rows.withColumn("priority", priority_of(F.col("opportunity_score"))).withColumn("reason", reason).drop("__core", "__t", "__q", "__copy")


def rank_discussions(scored: DataFrame, most: int = DISCUSSIONS_KEPT) -> DataFrame:
    """A crawl's best posts: one for each permalink (first query), by score, then permalink."""
    first = F.row_number().over(Window.partitionBy("crawl_run_id", "permalink").orderBy("query_ord", "post_ord"))
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("opportunity_score"), "permalink"))
    return scored.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("place", place).where(F.col("place") <= most)


def subreddit_rollup(ranked: DataFrame) -> DataFrame:
    """Posts, high-priority posts and share of each community in a crawl."""
    per = ranked.groupBy("crawl_run_id", "subreddit").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("priority") == "high").alias("high"))
    return per.withColumn("pct", js_round(F.col("posts") / F.sum("posts").over(Window.partitionBy("crawl_run_id")) * 100))


def discussion_topic_share(ranked: DataFrame) -> DataFrame:
    """How many of a crawl's posts share a topic."""
    per = ranked.groupBy("crawl_run_id", "query").agg(F.count(F.lit(1)).alias("posts"))
    return per.withColumn("of_posts", F.sum("posts").over(Window.partitionBy("crawl_run_id")))


def customer_phrases(ranked: DataFrame) -> DataFrame:
    """Distinct phrases of the first four longer words of a crawl's first eight titles."""
    words = F.slice(F.filter(F.split("title", r"\s+"), lambda w: F.length(w) > 3), 1, 4)
    return ranked.where("place <= 8").select("crawl_run_id", F.array_join(words, " ").alias("phrase")).where("length(phrase) > 5").distinct()
