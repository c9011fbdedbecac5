"""Scans over time: history, comparison, latest state and entitlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import js_round

_COUNTS = ["issue_count", "opportunities", "discussions", "content"]


def module_counts(runs: DataFrame, issues: DataFrame, opportunities: DataFrame, discussions: DataFrame, content: DataFrame, answers: DataFrame) -> DataFrame:
    """Runs with the counts of each module; every table is aggregated once by run and joined."""
    out = runs
    for name, rows in zip(_COUNTS, (issues, opportunities, discussions, content), strict=True):
        out = out.join(rows.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias(name)), "crawl_run_id", "left")
    ai = answers.groupBy("crawl_run_id").agg(
        F.count(F.lit(1)).alias("ai_total"), F.count_if("mentioned").alias("ai_mentioned"), F.count_if("cited").alias("ai_cited"), js_round(F.avg("visibility_score")).alias("ai_score")
    )
    return out.join(ai, "crawl_run_id", "left").na.fill(0, _COUNTS)


def scan_history(counted: DataFrame) -> DataFrame:
    """Completed runs of each project with their place, newest first. ``counted`` is from ``module_counts``."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("crawl_run_id"))
    return counted.where("status = 'COMPLETED'").withColumn("scan_rank", F.row_number().over(newest))


def _delta(name: str) -> Column:
    return (F.col(name) - F.col(f"previous_{name}")).alias(f"{name}_delta")


def scan_comparison(history: DataFrame) -> DataFrame:
    """The latest completed run of each project against the one before; deltas are null without one.

    Module deltas need both counts above zero, AI deltas answers in both runs.
    """
    names = ["health_score", "pages_discovered", "pages_crawled", *_COUNTS, "ai_total", "ai_mentioned", "ai_cited", "ai_score"]
    older = Window.partitionBy("project_id").orderBy("created_at", "crawl_run_id")
    # Only the two newest runs of a project matter, so the rest go before the comparison.
    two = history.where("scan_rank <= 2")
    rows = two.select("*", F.lag("crawl_run_id").over(older).alias("previous_run"), *[F.lag(n).over(older).alias(f"previous_{n}") for n in names]).where("scan_rank = 1")
    both = lambda n: F.when((F.col(n) > 0) & (F.col(f"previous_{n}") > 0), F.col(n) - F.col(f"previous_{n}")).alias(f"{n}_delta")
    ai = lambda n: F.when(F.col("ai_total").isNotNull() & F.col("previous_ai_total").isNotNull(), F.col(n) - F.col(f"previous_{n}")).alias(f"{n}_delta")
    return rows.select(
        "project_id",
        "crawl_run_id",
        "previous_run",
        *[c for n in ("health_score", "pages_discovered", "pages_crawled", "issue_count") for c in (F.col(n), F.col(f"previous_{n}"), _delta(n))],
        *[both(n) for n in ("opportunities", "discussions", "content")],
        *[ai(n) for n in ("ai_score", "ai_mentioned", "ai_cited")],
    )


def issue_type_deltas(history: DataFrame, issues: DataFrame) -> DataFrame:
    """(project_id, issue_type, issues_from, issues_to, issues_delta) between the two newest completed runs."""
    two = history.where("scan_rank <= 2").select("project_id", "crawl_run_id", "scan_rank")
    pairs = two.groupBy("project_id").agg(F.max("scan_rank").alias("n")).where("n = 2").select("project_id")
    counted = issues.groupBy("crawl_run_id", "issue_type").agg(F.count(F.lit(1)).alias("n")).join(two.join(pairs, "project_id", "left_semi"), "crawl_run_id")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("scan_rank") == k, F.col("n"))), F.lit(0))
    return counted.groupBy("project_id", "issue_type").agg(of(2).alias("issues_from"), of(1).alias("issues_to")).withColumn("issues_delta", F.col("issues_to") - F.col("issues_from"))


def improvements_regressions(comparison: DataFrame) -> DataFrame:
    """(project_id, kind, sentence) for each change worth telling."""
    c = F.col
    h, i, p, o, n = c("health_score_delta"), c("issue_count_delta"), c("pages_crawled_delta"), c("opportunities_delta"), c("content_delta")
    s, d = c("ai_score_delta"), c("ai_cited_delta")
    told = lambda kind, when, text: F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("sentence")))
    up, down = "improvement", "regression"
    span = lambda name: (c(f"previous_{name}"), c(name))
    rules = [
        told(up, h > 0, F.format_string("Health score improved +%d (%d → %d).", h, *span("health_score"))),
        told(down, h < 0, F.format_string("Health score declined %d (%d → %d).", h, *span("health_score"))),
        told(up, i < 0, F.format_string("Technical issues reduced by %d (%d → %d).", -i, *span("issue_count"))),
        told(down, i > 0, F.format_string("Technical issues increased by +%d (%d → %d).", i, *span("issue_count"))),
        told(up, p > 0, F.format_string("Crawl coverage grew from %d to %d pages.", *span("pages_crawled"))),
        told(down, p < 0, F.format_string("Crawl coverage shrank from %d to %d pages.", *span("pages_crawled"))),
        told(up, o > 0, F.format_string("+%d more search opportunities identified.", o)),
        told(down, o < 0, F.format_string("%d fewer search opportunities identified.", -o)),
        told(up, n > 0, F.format_string("+%d more content recommendations generated.", n)),
        told(down, n < 0, F.format_string("%d fewer content recommendations generated.", -n)),
        told(up, s > 0, F.format_string("AI visibility score improved +%d.", s)),
        told(down, s < 0, F.format_string("AI visibility score declined %d.", s)),
        told(up, d > 0, F.format_string("+%d more AI citations detected.", d)),
        told(down, d < 0, F.format_string("%d fewer AI citations detected.", -d)),
    ]
    found = F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull()))
    return comparison.where("previous_run is not null").select("project_id", found.alias("f")).select("project_id", "f.kind", "f.sentence")


def latest_scan_per_project(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """Every project with its newest run, whatever its state, and its number of runs."""
    last = F.max_by(F.struct("crawl_run_id", "status", "health_score", "pages_crawled"), F.struct("created_at", "crawl_run_id"))
    by = runs.groupBy("project_id").agg(F.count(F.lit(1)).alias("scan_count"), last.alias("latest"))
    out = projects.join(by, "project_id", "left")
    return out.select("project_id", F.coalesce("scan_count", F.lit(0)).cast("bigint").alias("scan_count"), *[F.col(f"latest.{c}").alias(f"latest_{c}") for c in ("crawl_run_id", "status", "health_score", "pages_crawled")])


def scan_counts_by_user(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, scans, completed) over all of a user's projects."""
    per = runs.groupBy("project_id").agg(F.count(F.lit(1)).alias("scans"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))
    return projects.join(per, "project_id").groupBy("user_id").agg(F.sum("scans").alias("scans"), F.sum("completed").alias("completed"))


def scan_entitlement(users: DataFrame, projects: DataFrame, runs: DataFrame) -> DataFrame:
    """(user_id, plan, can_scan): a free user stops at one project and one completed scan."""
    n_projects = projects.groupBy("user_id").agg(F.count(F.lit(1)).alias("projects"))
    rows = users.join(n_projects, "user_id", "left").join(scan_counts_by_user(projects, runs), "user_id", "left")
    blocked = (F.coalesce("plan", F.lit("free")) != "pro") & (F.coalesce("projects", F.lit(0)) >= 1) & (F.coalesce("completed", F.lit(0)) >= 1)
    return rows.select("user_id", F.coalesce("plan", F.lit("free")).alias("plan"), (~blocked).alias("can_scan"))


def issues_by_severity(issues: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` findings of a crawl: errors, warnings, then notes."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(rank, "issue_type", F.col("page_id").asc_nulls_first(), "message"))
    return issues.withColumn("place", place).where(F.col("place") <= most)


def affected_pages(issues: DataFrame, pages: DataFrame, most: int = 15) -> DataFrame:
    """(crawl_run_id, url, issues, errors, warnings): a crawl's pages with most findings."""
    per = issues.where("page_id is not null").groupBy("crawl_run_id", "page_id").agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")
    )
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy(F.desc("issues"), "page_id"))
    top = per.withColumn("place", place).where(F.col("place") <= most)
    urls = pages.select("crawl_run_id", "page_id", "url")
    return top.join(urls, ["crawl_run_id", "page_id"], "left").select("crawl_run_id", "place", F.coalesce("url", F.lit("Unknown")).alias("url"), "issues", "errors", "warnings")


def remediation_groups(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """(crawl_run_id, issue_type, issues, affected_paths, tier): work by type of finding."""
    paths = pages.select("crawl_run_id", "page_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
    per = issues.join(paths, ["crawl_run_id", "page_id"], "left").groupBy("crawl_run_id", "issue_type", "path").agg(F.count(F.lit(1)).alias("n"), F.min("severity").alias("severity"))
    groups = per.groupBy("crawl_run_id", "issue_type").agg(F.sum("n").alias("issues"), F.count("path").alias("affected_paths"), F.min("severity").alias("severity"))
    tier = F.when(F.col("severity") == "error", "high").when(F.col("severity") == "warning", "medium").otherwise("low")
    return groups.select("crawl_run_id", "issue_type", "issues", "affected_paths", tier.alias("tier"))
