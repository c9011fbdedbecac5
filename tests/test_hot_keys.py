"""Large crawls and hosts: results without broadcasts, and plans that don't join rows on the crawl or host alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitemetry.functions import urls
from sitemetry.operators import content, discussions, links, opportunities
from sitemetry.sources import html, tables


def shuffled_keys(df):
    """Key names of the joins that deal both sides."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [[k.split("#")[0] for k in keys.split(", ")] for keys in re.findall(r"(?:SortMergeJoin|ShuffledHashJoin)(?:\(skew=true\))? \[([^\]]*)\]", plan)]


@pytest.fixture(params=["broadcast", "shuffled"])
def sides(request, spark, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_robots_by_prefix(spark, sides):
    r = random.Random(1)
    parts = ["a", "b", "ab", "*", "/", "/a", "/b*", ""]
    rules = [(h, 1, "*", k, r.random() < 0.5, "/" + "".join(r.choice(parts) for _ in range(r.randrange(0, 5)))) for h in ("big", "small") for k in range(12)]
    rules += [("big", 1, "*", 50, False, "*b"), ("none", 1, "*", 0, None, None), ("big", 2, "named", 0, True, "/"), ("small", 1, "*", 60, True, "/[.]")]
    robots = spark.createDataFrame(rules, "host string, group_ord int, agent string, rule_ord int, allow boolean, pattern string")
    paths = ["/" + "".join(r.choice(["a", "b", "/"]) for _ in range(r.randrange(0, 9))) for _ in range(300)] + ["", "/[.]x", "/a?b=a"]
    given = [(h, f"https://{h}{p}") for p in paths for h in ("big",) * 9 + ("small", "none", "unknown")]

    def allowed(host, url):
        path = re.match(r"https://[^/?]*([^?]*)", url)[1] or "/"
        best = None
        for h, group, _, at, allow, pattern in rules:
            if h == host and group == 1 and pattern is not None and re.match("^" + ".*".join(map(re.escape, pattern.split("*"))), path):
                key = (len(pattern.split("*")[0]), -at)
                best = max(best or (key, allow), (key, allow))
        return best is None or best[1]

    got = links.robots_allowed(spark.createDataFrame(given, "host string, url string"), robots, "other/1.0")
    assert {(x["host"], x["url"]): x["allowed"] for x in got.collect()} == {g: allowed(*g) for g in given}
    assert got.count() == len(given)
    assert ["host"] not in shuffled_keys(got)
    assert all(x["allowed"] for x in links.robots_allowed(spark.createDataFrame(given, "host string, url string"), robots.limit(0), "x").limit(9).collect())


def test_orphans_of_a_large_crawl(spark, sides):
    schema = "crawl_run_id string, page_id string, page_seq long, url string, internal_links array<string>, best_term string, best_freq long, p_title string, p_slug string, p_meta string"
    rows = [("big", str(i), i, f"https://big/{i}", [f"https://big/{2 * i}"], None, None, "", "x", "") for i in range(90)]
    rows += [("alone", "1", 1, "https://alone/", [], None, None, "", "x", ""), ("two", "1", 1, "https://two/1", None, None, None, "", "x", ""), ("two", "2", 2, "https://two/2", ["https://two/1"], None, None, "", "x", "")]
    got = opportunities.orphan_pages(spark.createDataFrame(rows, schema))
    assert {x["related_page_url"] for x in got.collect()} == {f"https://big/{i}" for i in range(1, 90, 2)} | {"https://two/2"}
    assert ["crawl_run_id"] not in shuffled_keys(got)


def test_link_suggestions_of_a_large_crawl(spark, sides):
    r = random.Random(3)
    topics = [("big", 1, "Green Gardens"), ("big", 2, "tool for trees"), ("big", 3, "an odd of it"), ("small", 1, "garden")]
    plan = spark.createDataFrame(topics, "crawl_run_id string, place int, topic string")
    words = ["garden", "gardens", "Green", "tree", "trees", "tools", "pots", "gard", "reen", ""]
    pages = [(c, i, f"https://{c}/{r.choice(words)}-{i}", r.choice([None, f"{r.choice(words)} {r.choice(words)}"])) for c, n in (("big", 90), ("small", 10), ("other", 5)) for i in range(n)]
    key = lambda url: url.removeprefix("https://").rstrip("/")
    edges = {(c, key(r.choice(pages)[2]), key(r.choice(pages)[2])) for c in ("big", "small") for _ in range(900)}
    want = []
    for c in ("big", "small"):
        used, found = set(), []
        for _, place, topic in [t for t in topics if t[0] == c]:
            look = [w for w in re.split("[^a-z0-9]+", topic.lower()) if len(w) > 3]
            fit = sorted((i, key(u)) for cc, i, u, t in pages if cc == c and any(w in (t or "").lower() or w in u.lower() for w in look))
            for a, (_, s) in enumerate(fit):
                for _, t in fit[a + 1 :]:
                    if (c, s, t) not in edges and (c, t, s) not in edges and tuple(sorted((s, t))) not in used and len(found) < 8:
                        used.add(tuple(sorted((s, t))))
                        found.append((c, len(found) + 1, s, t, topic))
        want += found
    got = content.content_link_suggestions(plan, spark.createDataFrame(pages, "crawl_run_id string, page_seq long, url string, title string"), spark.createDataFrame(sorted(edges), "crawl_run_id string, source string, target string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 16
    assert ["crawl_run_id"] not in shuffled_keys(got)


def test_repeated_posts_are_scored_each(spark, sides):
    from datetime import datetime

    schema = "crawl_run_id string, query string, query_ord long, post_ord long, subreddit string, title string, permalink string, author string, score long, num_comments long, created_at timestamp, body_snippet string"
    post = ("c", "garden soil", 0, 1, "s", "Garden soil for garden beds", "/p", None, 5, 2, None, "soil soil beds")
    rows = [post] * 3 + [(*post[:3], 2, "s", "", "/q", None, 0, 0, None, None), ("d", *post[1:])]
    core = spark.createDataFrame([("c", "soil"), ("c", "garden beds"), ("e", "garden")], "crawl_run_id string, term string")
    got = discussions.score_discussions(spark.createDataFrame(rows, schema), core, datetime(2024, 1, 1))
    assert sorted((x["crawl_run_id"], x["post_ord"], x["relevance"]) for x in got.collect()) == [("c", 1, 38)] * 3 + [("c", 2, 8), ("d", 1, 20)]
    assert sorted(got.columns) == sorted([c.split()[0] for c in schema.split(", ")] + ["relevance", "impact", "confidence", "opportunity_score", "priority", "reason"])


LINKS = ["", " ", "#x", "?q=1#x", "a", "./a/", "../a b", "../../../a", "/a//b/", "//www.example.com:443/x/", "//other.org/x", "HTTPS://EXAMPLE.com/A/", "http://example.com:80", "mailto:a@example.com", "javascript:void(0)", "https://example.com.evil.test/", "https://user:pw@m.example.com/é?ü=1", "a/../b/./c/..", "%2e%2e/x", "https:///x", "ftp://example.com/"]
BASES = ["https://www.example.com", "https://www.example.com/a/b/c?x=1", "http://example.com/a/", "https://other.org/a/b"]


def test_links_resolve_alike_in_columns_and_in_the_parser(spark):
    given = [(h, b) for h in LINKS for b in BASES]
    got = spark.createDataFrame(given, "href string, base string").select("href", "base", urls.internal_link(F.col("href"), F.col("base"), F.lit("example.com")).alias("link"))
    assert {(x["href"], x["base"]): x["link"] for x in got.collect()} == {(h, b): html.internal_link(h, b, "example.com") for h, b in given}
    assert html.internal_link("../a b", BASES[1], "example.com") == "https://www.example.com/a/a%20b"
