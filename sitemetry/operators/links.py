"""The link graph of crawls: edges, discovered URLs, robots rules, targets and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.urls import hostname_of, link_key, path_of
from ..sources.tables import measured
from .audit import content_pages

# IPv4 ranges that are no public target (first and last address).
PRIVATE_RANGES = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "239.255.255.255"),
    ("240.0.0.0", "255.255.255.255"),
]
PRIVATE_V6 = r"^(::1|::|f[cd].*|fe[89ab].*|2001:db8:.*)$"


def link_graph(pages: DataFrame) -> DataFrame:
    """Distinct edges (crawl_run_id, source, target) of HTML pages, by host and path."""
    edges = pages.where(R.is_html(F.col("content_type"))).select("crawl_run_id", link_key(F.col("url")).alias("source"), F.explode("internal_links").alias("link"))
    return edges.select("crawl_run_id", "source", link_key(F.col("link")).alias("target")).distinct()


def discovered_urls(pages: DataFrame, runs: DataFrame, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """Distinct (crawl_run_id, url): seeds, sitemap URLs and links of content pages."""
    found = runs.select("crawl_run_id", F.concat("website_url", F.lit("/")).alias("url")).union(content_pages(pages).select("crawl_run_id", F.explode("internal_links").alias("url")))
    if sitemap_urls is not None:
        found = found.union(sitemap_urls.select("crawl_run_id", "url"))
    return found.distinct()


def _robots_lines(files: DataFrame) -> DataFrame:
    """(host, pos, field, value) of the lines of (host, body) robots.txt texts."""
    line = F.trim(F.regexp_replace("line", r"^[\s]+|[\s]+$", ""))
    rows = files.select("host", F.posexplode(F.split("body", "\r?\n")).alias("pos", "line")).withColumn("line", line).where("line != '' and not startswith(line, '#') and contains(line, ':')")
    return rows.select("host", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """Distinct (host, sitemap): the sitemaps that (host, body) robots.txt texts name, whatever group they stand in."""
    return _robots_lines(files).where("field = 'sitemap'").select("host", F.col("value").alias("sitemap")).distinct()


def parse_robots(files: DataFrame) -> DataFrame:
    """(host, group_ord, agent, rule_ord, allow, pattern) from (host, body) robots.txt texts.

    Agent lines in a row share a group; one after rules starts a new group. A group without rules
    has one row with a null pattern for each agent.
    """
    rows = _robots_lines(files).where("field = 'user-agent' or (field in ('allow', 'disallow') and value != '')")
    by_host = Window.partitionBy("host").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("field").over(by_host) == "user-agent", F.lit(False))
    rows = rows.withColumn("group_ord", F.sum(starts.cast("int")).over(by_host)).where("group_ord > 0")
    agents = rows.where(is_agent).select("host", "group_ord", F.lower("value").alias("agent"))
    told = rows.where(~is_agent).select("host", "group_ord", F.col("pos").alias("rule_ord"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(told, ["host", "group_ord"], "left")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` (host, url) with ``allowed``: the agent's group or ``*``; the longest matching rule, first on ties.

    Rules are looked up by host and the literal start of their pattern: a path is cut at the lengths that
    these starts have (a number, collected: patterns are short and lengths few), and only rules with
    wildcards are compared further. Rules are broadcast if they are measured small; beyond that URLs
    are dealt by host and start, and Spark splits what a large host has too much.
    """
    token = agent.lower().split("/")[0].split(" ")[0]
    fit = robots.where(F.col("agent").isin(token, "*"))
    chosen = fit.groupBy("host").agg(F.min(F.struct((F.col("agent") == "*").alias("general"), "group_ord")).alias("c")).select("host", F.col("c.group_ord").alias("group_ord"))
    rules = fit.join(chosen, ["host", "group_ord"]).where("pattern is not null").select("host", "rule_ord", "allow", "pattern", F.substring_index("pattern", "*", 1).alias("start")).distinct()
    rules = measured(rules, F.length("host") + 2 * F.length("pattern") + 32)
    sizes = [F.lit(r[0]) for r in rules.select(F.length("start")).distinct().collect()]
    path = path_of(F.col("url"))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(F.split("pattern", r"\*"), lambda p: F.concat(F.lit("\\Q"), p, F.lit("\\E"))), ".*"))
    matches = ~F.contains("pattern", F.lit("*")) | F.regexp_like(path, regex)
    starts = F.transform(F.filter(F.array(*sizes).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    hit = urls.select("host", "url").distinct().withColumn("start", F.explode(starts)).join(rules, ["host", "start"]).where(matches)
    best = hit.groupBy("host", "url").agg(F.max_by("allow", F.struct(F.length("start").alias("n"), (-F.col("rule_ord")).alias("o"))).alias("rule"))
    return urls.join(best, ["host", "url"], "left").withColumn("allowed", F.coalesce("rule", F.lit(True))).drop("rule")


def crawl_frontier(discovered: DataFrame, pages: DataFrame, robots: DataFrame, agent: str, most: int) -> DataFrame:
    """The next ``most`` discovered, uncrawled and allowed URLs of each crawl, by URL."""
    left = discovered.join(pages.select("crawl_run_id", "url"), ["crawl_run_id", "url"], "left_anti").withColumn("host", hostname_of(F.col("url")))
    place = F.row_number().over(Window.partitionBy("crawl_run_id").orderBy("url"))
    allowed = robots_allowed(left, robots, agent).where("allowed").withColumn("place", place)
    return allowed.where(F.col("place") <= most).select("crawl_run_id", "place", "url")


def ipv4_number(ip):
    parts = F.split(ip, r"\.")
    part = lambda k: F.try_cast(F.get(parts, F.lit(k)), "bigint") if hasattr(F, "try_cast") else F.get(parts, F.lit(k)).try_cast("bigint")
    return F.when(ip.rlike(r"^[0-9]+(\.[0-9]+){3}$"), part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3))


def private_ranges(spark) -> DataFrame:
    """The fourteen ranges as numbers (lo, hi)."""
    number = lambda ip: sum(int(x) << (24 - 8 * i) for i, x in enumerate(ip.split(".")))
    return spark.createDataFrame([(number(a), number(b)) for a, b in PRIVATE_RANGES], "lo bigint, hi bigint")


def private_target_filter(targets: DataFrame) -> DataFrame:
    """``targets`` (host, ...) without local names and private or reserved address literals."""
    host = F.regexp_replace(F.lower(F.trim("host")), r"\.$", "")
    mapped = F.regexp_extract(host, r"^::ffff:([0-9]+(?:\.[0-9]+){3})$", 1)
    address = ipv4_number(F.when(mapped != "", mapped).otherwise(host))
    local = (host == "") | (host == "localhost") | F.endswith(host, F.lit(".localhost")) | (F.contains(host, F.lit(":")) & (mapped == "") & host.rlike(PRIVATE_V6))
    rows = targets.where(~F.coalesce(local, F.lit(True))).withColumn("__ip", address)
    ranges = F.broadcast(private_ranges(targets.sparkSession))  # fourteen rows
    return rows.join(ranges, (F.col("__ip") >= F.col("lo")) & (F.col("__ip") <= F.col("hi")), "left_anti").drop("__ip")
