"""AI-answer visibility: mentions, scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import literals
from ..functions.text import js_round

# Phrases that show a stance.
NEGATIVE = ["avoid", "not recommended", "do not recommend", "poor", "disappointing", "unreliable", "buggy", "outdated", "skip", "lacks", "behind"]
POSITIVE = ["recommend", "recommended", "best", "top pick", "top tool", "great choice", "good option", "excellent", "useful", "helpful", "worth"]
COMPETITORS_KEPT = 6

# Patterns of URLs, domain-like words and bold names in an answer.
_URL = r"(?i)(https?://[^\s<>\"']+)"
_DOMAIN = r"([a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)*)"
_BOLD = r"\*\*([^*]+?)\*\*"


def _hosts(text: Column) -> Column:
    """Hosts of URLs, then domain-like words, without ``www.``, each once, in order."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(_URL), F.lit(1)), lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_DOMAIN), F.lit(1)), lambda d: F.regexp_replace(d, r"^www\.", ""))
    words = F.filter(words, lambda d: ~d.rlike(r"^u\.?s\.?$"))
    return F.array_distinct(F.filter(F.concat(urls, words), lambda h: h != ""))


def _brands(text: Column) -> Column:
    """Names in bold with a colon, split at slashes."""
    bold = F.filter(F.regexp_extract_all(text, F.lit(_BOLD), F.lit(1)), lambda b: F.contains(b, F.lit(":")))
    names = F.filter(F.transform(bold, lambda b: F.trim(F.regexp_replace(b, ":$", ""))), lambda n: (n != "") & ~n.rlike("^[0-9]"))
    parts = F.transform(F.flatten(F.transform(names, lambda n: F.split(n, "/"))), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.rlike(r"(?i)^(u\.?s\.?|for\s)") & ~p.rlike(r"[()]"))


def mention_analysis(answers: DataFrame) -> DataFrame:
    """``answers`` (raw_response, domain, ...) with mentioned, cited, stance and competitors.

    An empty domain is never mentioned.
    """
    text = F.coalesce("raw_response", F.lit(""))
    lower = F.lower(text)
    host = F.lower(F.regexp_replace(F.coalesce("domain", F.lit("")), r"^www\.", ""))
    brand = F.when(host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), host).otherwise(F.regexp_extract(host, "^([a-z0-9][a-z0-9-]*)", 1))
    df = answers.withColumn("__hosts", _hosts(text)).withColumn("__host", host).withColumn("__brand", brand)
    known = F.col("__host") != ""
    cited = known & F.array_contains("__hosts", F.col("__host"))
    # The brand is a run of a-z, 0-9 and hyphens, so it stands for itself in a pattern.
    as_word = F.regexp_like(lower, F.concat(F.lit("(^|[^a-z0-9_])"), "__brand", F.lit("($|[^a-z0-9_])")))
    mentioned = known & (cited | F.contains(lower, F.col("__host")) | ((F.col("__brand") != F.col("__host")) & (F.col("__brand") != "") & as_word))
    has = lambda signals: F.exists(literals(signals), lambda s: F.contains(lower, s))
    stance = F.when(~F.col("mentioned"), "absent").when(has(NEGATIVE), "negative").when(has(POSITIVE), "recommendation").otherwise("neutral")
    named = F.filter(F.concat("__hosts", _brands(text)), lambda c: F.lower(c) != F.col("__host"))
    first = F.filter(F.transform(named, lambda c, i: F.when(~F.array_contains(F.transform(F.slice(named, 1, i), lambda x: F.lower(x)), F.lower(c)), c)), lambda c: c.isNotNull())
    df = df.withColumn("cited", cited).withColumn("mentioned", mentioned).withColumn("stance", stance).withColumn("competitors", F.slice(first, 1, COMPETITORS_KEPT))
    return df.drop("__hosts", "__host", "__brand")


def visibility_score(mentioned: Column, cited: Column, stance: Column) -> Column:
    points = F.when(stance == "recommendation", 30).when(stance == "neutral", 10).when(stance == "negative", -10).otherwise(0)
    total = F.when(cited, 40).otherwise(0) + F.when(mentioned, 30 + points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def visibility_reason(topic: Column, domain: Column) -> Column:
    """Why an analysed answer scores as it does."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return (
        F.when(F.trim(F.coalesce("raw_response", F.lit(""))) == "", F.concat(F.lit("The model returned an empty response for "), quoted(topic), F.lit(".")))
        .when(~F.col("mentioned"), F.concat(quoted(domain), F.lit(" was not mentioned in the answer to "), quoted(topic), F.lit(".")))
        .when(F.col("cited"), F.concat(quoted(domain), F.lit(" was mentioned and linked in the answer to "), quoted(topic), F.lit(".")))
        .otherwise(F.concat(quoted(domain), F.lit(" appeared in the answer to "), quoted(topic), F.lit(" ("), F.col("stance"), F.lit(").")))
    )


def display_score(score: Column) -> Column:
    """Rounded to fives, between 15 and 75."""
    return F.least(F.lit(75), F.greatest(F.lit(15), js_round(score / 5) * 5))


def topic_from_prompt(prompt: Column) -> Column:
    """The last quoted phrase, for the view."""
    found = F.regexp_extract(prompt, r'"([^"]+)"\??\s*$', 1)
    return F.when(found == "", prompt).otherwise(found)


def planner_topic(prompt: Column) -> Column:
    """The first quoted phrase, for the planner."""
    found = F.regexp_extract(prompt, '"([^"]+)"', 1)
    return F.trim(F.when(found == "", prompt).otherwise(found))


def analyzed(answers: DataFrame) -> DataFrame:
    """Answers (crawl_run_id, prompt, raw_response, domain) with the analysis, score and reason."""
    rows = mention_analysis(answers)
    topic = topic_from_prompt(F.col("prompt"))
    return rows.withColumn("visibility_score", visibility_score(F.col("mentioned"), F.col("cited"), F.col("stance"))).withColumn("topic", topic).withColumn("reason", visibility_reason(topic, F.col("domain")))


def visibility_summary(results: DataFrame) -> DataFrame:
    """Counts and the mean score of each crawl's answers."""
    mean = js_round(F.avg("visibility_score"))
    return results.groupBy("crawl_run_id").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if("mentioned").alias("mentioned"),
        F.count_if("cited").alias("cited"),
        F.count_if(F.col("stance") == "recommendation").alias("recommended"),
        mean.alias("score"),
        display_score(mean).alias("display"),
    )


def visibility_rates(results: DataFrame) -> DataFrame:
    """Shares of mentions and citations, stances, and the level of topic coverage."""
    a = results.groupBy("crawl_run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("mentioned").alias("m"),
        F.count_if("cited").alias("c"),
        F.count_if(F.col("mentioned") | F.col("cited")).alias("covered"),
        *[F.count_if(F.col("stance") == s).alias(s) for s in ("recommendation", "neutral", "negative")],
    )
    pct = lambda x: js_round(F.col(x) / F.col("n") * 100)
    covered = pct("covered")
    level = F.when(covered >= 70, "Strong").when(covered >= 40, "Partial").otherwise("Weak")
    return a.select("crawl_run_id", pct("m").alias("mention_pct"), pct("c").alias("cite_pct"), "recommendation", "neutral", "negative", covered.alias("topic_pct"), level.alias("topic_level"))


def top_competitors(results: DataFrame, most: int = 6) -> DataFrame:
    """(crawl_run_id, place, competitor, answers): the names that most answers hold."""
    counted = results.select("crawl_run_id", F.explode("competitors").alias("competitor")).groupBy("crawl_run_id", "competitor").agg(F.count(F.lit(1)).alias("answers"))
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("answers"), "competitor"))
    return counted.withColumn("place", place).where(F.col("place") <= most)


def visibility_actions(results: DataFrame) -> DataFrame:
    """(crawl_run_id, step, priority, title): what to do, from the counts of a crawl's answers."""
    a = results.groupBy("crawl_run_id").agg(
        F.count_if(~F.col("mentioned")).alias("missing"), F.count_if("mentioned").alias("mentioned"), F.count_if("cited").alias("cited"), F.count_if(F.size("competitors") > 0).alias("rivals")
    )
    c = F.col
    told = lambda when, priority, title: F.when(when, F.struct(F.lit(priority).alias("priority"), title.alias("title")))
    rules = [
        told(c("missing") > 0, "high", F.concat(F.format_string("Expand content coverage for %d missing topic", c("missing")), F.when(c("missing") > 1, "s").otherwise(""))),
        told((c("mentioned") > 0) & (c("cited") == 0), "high", F.lit("Improve citation readiness")),
        told((c("mentioned") > 0) & (c("cited") > 0), "medium", F.lit("Strengthen cited topics")),
        told(c("rivals") > 0, "medium", F.lit("Analyze competitor visibility")),
    ]
    found = F.posexplode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("pos", "a")
    return a.select("crawl_run_id", found).select("crawl_run_id", (F.col("pos") + 1).alias("step"), "a.priority", "a.title")
