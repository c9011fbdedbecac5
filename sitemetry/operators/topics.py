"""Topics of a crawl's content pages: terms of titles, descriptions and URL slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.text import significant_tokens, term_candidates, text_or_empty
from ..functions.urls import host_label, slug_phrase
from .audit import content_pages


def page_profiles(pages: DataFrame) -> DataFrame:
    """Content pages with trimmed title and description, slug phrase and their tokens."""
    rows = content_pages(pages).withColumn("p_title", text_or_empty(F.col("title"))).withColumn("p_meta", text_or_empty(F.col("meta_description"))).withColumn("p_slug", slug_phrase(F.col("url")))
    for k in ("title", "meta", "slug"):
        rows = rows.withColumn(f"{k}_tokens", significant_tokens(F.col(f"p_{k}")))
    return rows.withColumn("all_tokens", F.array_distinct(F.concat("title_tokens", "meta_tokens", "slug_tokens")))


def topic_pages(profiles: DataFrame) -> DataFrame:
    """(crawl_run_id, term, page_id, page_seq, dedicated): pages that have a term; dedicated if in title or slug.

    The wide key spreads a hot crawl over all tasks; the count of pages comes later.
    """
    tagged = F.array(*[F.struct(term_candidates(F.col(f"{k}_tokens")).alias("terms"), F.lit(k != "meta").alias("dedicated")) for k in ("title", "meta", "slug")])
    rows = profiles.select("crawl_run_id", "page_id", "page_seq", F.explode(tagged).alias("t"))
    rows = rows.select("crawl_run_id", "page_id", "page_seq", "t.dedicated", F.explode("t.terms").alias("term"))
    return rows.groupBy("crawl_run_id", "term", "page_id").agg(F.min("page_seq").alias("page_seq"), F.bool_or("dedicated").alias("dedicated"))


def extract_topics(on_pages: DataFrame) -> DataFrame:
    """(crawl_run_id, term, doc_freq, dedicated_pages, is_bigram) from ``topic_pages``."""
    return on_pages.groupBy("crawl_run_id", "term").agg(F.count(F.lit(1)).alias("doc_freq"), F.count_if("dedicated").alias("dedicated_pages")).withColumn("is_bigram", F.contains("term", F.lit(" ")))


def topics_analyzed(topics: DataFrame) -> DataFrame:
    return topics.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("topics"))


def core_topics(topics: DataFrame) -> DataFrame:
    """Topics on several pages, with their rank in the crawl: most pages first, then by term."""
    order = Window.partitionBy("crawl_run_id").orderBy(F.desc("doc_freq"), "term")
    return topics.where(F.col("doc_freq") >= R.CORE_TOPIC_PAGES).withColumn("topic_rank", F.row_number().over(order))


def best_topics(profiles: DataFrame, core: DataFrame) -> DataFrame:
    """(crawl_run_id, page_id, best_term, best_freq): the highest-ranked core topic that the page holds.

    It is always a single word: a pair's first word is on every page of the pair, so it has no fewer
    pages, and sorts before it. So an equi-join on single words finds it.
    """
    words = profiles.select("crawl_run_id", "page_id", F.explode("all_tokens").alias("term"))
    single = core.where("not is_bigram").select("crawl_run_id", "term", "doc_freq", "topic_rank")
    best = F.min(F.struct("topic_rank", "term", "doc_freq"))
    return words.join(single, ["crawl_run_id", "term"]).groupBy("crawl_run_id", "page_id").agg(best.alias("b")).select("crawl_run_id", "page_id", F.col("b.term").alias("best_term"), F.col("b.doc_freq").alias("best_freq"))


def site_brands(pages: DataFrame) -> DataFrame:
    """First label of the first content page's host."""
    return brands_of(content_pages(pages))


def brands_of(profiles: DataFrame) -> DataFrame:
    """``site_brands`` of content pages."""
    return profiles.groupBy("crawl_run_id").agg(F.min_by(host_label(F.col("url")), "page_seq").alias("brand"))


def ai_prompt_topics(topics: DataFrame, most: int = 5) -> DataFrame:
    """The topics to ask about: most pages, pairs before words, then by term; with the question."""
    order = Window.partitionBy("crawl_run_id").orderBy(F.desc("doc_freq"), F.desc("is_bigram"), "term")
    picked = topics.withColumn("prompt_rank", F.row_number().over(order)).where(F.col("prompt_rank") <= most)
    return picked.select("crawl_run_id", "prompt_rank", F.col("term").alias("topic"), build_prompt(F.col("term")).alias("prompt"))


def build_prompt(topic):
    """A neutral question about a topic that doesn't name the site."""
    # Fixed value: the wording of the question.
    head = (
        "You are a neutral research assistant. Answer concisely with a short list, and only mention tools, services "
        "or websites you are reasonably confident exist. Do not invent anything.\n\n"
        'Question: What are the best tools, services or websites for "'
    )
    return F.concat(F.lit(head), topic, F.lit('"?'))
