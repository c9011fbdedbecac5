"""Search-query metrics: fuzzy match to opportunities, enrichment, sites and snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import query_tokens
from ..functions.urls import site_hostname

MATCH_FROM, QUERIES_KEPT, FRESH_HOURS, WINDOW_DAYS = 0.6, 25, 6, 28


def query_match_score(a: Column, b: Column) -> Column:
    """Similarity of two token arrays: equal 1, a in b 0.8, b in a 0.7, else shared over distinct."""
    in_b = F.filter(a, lambda t: F.array_contains(b, t))
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .when(F.array_join(a, " ") == F.array_join(b, " "), F.lit(1.0))
        .when(F.size(in_b) == F.size(a), F.lit(0.8))
        .when(F.forall(b, lambda t: F.array_contains(a, t)), F.lit(0.7))
        .otherwise(F.size(in_b) / F.size(F.array_union(a, b)))
    )


def _matches(opportunities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics rows that match, all their columns, with ``opportunity_id`` and ``match_score``.

    A score at the threshold needs a shared token, so candidates come from an equi-join on (crawl,
    token) and none is lost. A pair is looked at where its first shared token meets, so it comes once
    and both sides are read once.
    """
    tokens = lambda c: F.array_distinct(query_tokens(F.col(c)))
    o = opportunities.select("crawl_run_id", "opportunity_id", "score", query_tokens(F.col("query")).alias("a"), F.explode(tokens("query")).alias("token"))
    row = F.struct(*[c for c in metrics.columns if c not in ("crawl_run_id", "row_ord")])
    m = metrics.select("crawl_run_id", "row_ord", row.alias("m"), query_tokens(F.col("query")).alias("b"), F.explode(tokens("query")).alias("token"))
    pairs = o.join(m, ["crawl_run_id", "token"]).where(F.col("token") == F.get(F.array_intersect("a", "b"), F.lit(0)))
    scored = pairs.withColumn("match_score", query_match_score(F.col("a"), F.col("b"))).where(F.col("match_score") >= MATCH_FROM)
    order = F.struct((-F.col("match_score")).alias("m"), F.col("score").alias("s"), F.col("opportunity_id").alias("o"))
    best = scored.groupBy("crawl_run_id", "row_ord").agg(F.min(order).alias("b"), F.any_value("m").alias("m"))
    return best.select("crawl_run_id", "row_ord", F.col("b.o").alias("opportunity_id"), (-F.col("b.m")).alias("match_score"), "m.*")


def match_queries(opportunities: DataFrame, metrics: DataFrame) -> DataFrame:
    """(crawl_run_id, row_ord, opportunity_id, match_score): each metrics row's single best opportunity.

    ``opportunities`` holds (crawl_run_id, opportunity_id, query, score), ``metrics`` (crawl_run_id,
    row_ord, query, ...) with one row for each row_ord of a crawl. Ties go to the lower score, then
    the lower id.
    """
    return _matches(opportunities, metrics.select("crawl_run_id", "row_ord", "query")).drop("query")


def _rounded(value: Column, digits: int) -> Column:
    return F.floor(value * 10**digits + 0.5) / F.lit(float(10**digits))


def enrich_opportunities(opportunities: DataFrame, metrics: DataFrame) -> DataFrame:
    """Opportunities with clicks, impressions, CTR, position and up to 25 queries; nulls where none matched."""
    rows = _matches(opportunities, metrics)
    place = F.row_number().over(Window.partitionBy("crawl_run_id", "opportunity_id").orderBy(F.desc("impressions"), F.desc("clicks"), "row_ord"))
    sums = (
        rows.withColumn("place", place)
        .groupBy("crawl_run_id", "opportunity_id")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            F.sum(F.col("position") * F.col("impressions")).alias("weighted"),
            F.array_sort(F.collect_list(F.when(F.col("place") <= QUERIES_KEPT, F.struct("place", "query")))).alias("kept"),
        )
    )
    shown = F.col("impressions") > 0
    facts = sums.select(
        "crawl_run_id",
        "opportunity_id",
        "clicks",
        "impressions",
        F.when(shown, _rounded(F.col("clicks") / F.col("impressions"), 4)).otherwise(0.0).alias("ctr"),
        F.when(shown, _rounded(F.col("weighted") / F.col("impressions"), 1)).otherwise(0.0).alias("position"),
        F.col("kept.query").alias("queries"),
    )
    return opportunities.join(facts, ["crawl_run_id", "opportunity_id"], "left")


def metrics_summary(opportunities: DataFrame, metrics: DataFrame) -> DataFrame:
    """(crawl_run_id, queries_fetched, queries_matched)."""
    matched = match_queries(opportunities, metrics).groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("queries_matched"))
    fetched = metrics.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("queries_fetched"))
    return fetched.join(matched, "crawl_run_id", "left").na.fill(0, ["queries_matched"])


def link_sites(projects: DataFrame, sites: DataFrame) -> DataFrame:
    """(project_id, site_url) for projects without a site whose domain is a property's host, within an owner.

    ``projects``: (project_id, user_id, domain, site_url); ``sites``: (user_id, site_url). Of several
    properties of a host the last URL counts.
    """
    by_host = sites.withColumn("domain", site_hostname(F.col("site_url"))).where("domain is not null").groupBy("user_id", "domain").agg(F.max("site_url").alias("linked_url"))
    open_ = projects.where("site_url is null").withColumn("domain", F.regexp_replace("domain", r"^www\.", ""))
    return open_.join(by_host, ["user_id", "domain"]).select("project_id", "user_id", F.col("linked_url").alias("site_url"))


def snapshot_freshness(sites: DataFrame, snapshots: DataFrame, as_of: datetime) -> DataFrame:
    """(site_url, stale, start_date, end_date): stale if there is no snapshot or it is older than six hours."""
    now = F.lit(as_of)
    last = snapshots.groupBy("site_url").agg(F.max("fetched_at").alias("fetched_at"))
    stale = F.col("fetched_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") > FRESH_HOURS * 3600)
    return sites.join(last, "site_url", "left").select("site_url", stale.alias("stale"), F.date_sub(now.cast("date"), WINDOW_DAYS - 1).alias("start_date"), now.cast("date").alias("end_date"))
