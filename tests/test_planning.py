from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitemetry.operators import content, links, visibility
from sitemetry.sources import html, payloads, tables
from sitemetry.streaming import jobs


def test_mentions(spark):
    text = [
        ("Use https://www.acme.com/x and **Rival: good** or other.io.", "www.acme.com", True, True, "neutral", ["other.io", "Rival: good"]),
        ("Avoid acme, it lacks features", "acme.com", True, False, "negative", []),
        ("acmeish is the best", "acme.com", False, False, "absent", []),
        ("The best is **Foo/Bar (x)/A:**", "acme.com", False, False, "absent", ["Foo"]),
        ("anything", "", False, False, "absent", []),
        (None, "acme.com", False, False, "absent", []),
    ]
    df = spark.createDataFrame([(i, t, d) for i, (t, d, *_) in enumerate(text)], "i int, raw_response string, domain string")
    got = {r["i"]: (r["mentioned"], r["cited"], r["stance"], r["competitors"]) for r in visibility.mention_analysis(df).collect()}
    assert got == {i: tuple(t[2:]) for i, t in enumerate(text)}


def test_visibility_scores(spark):
    rows = [(True, True, "recommendation", 100), (True, True, "neutral", 80), (True, True, "negative", 60), (True, False, "neutral", 40), (True, False, "negative", 20), (False, False, "absent", 0)]
    df = spark.createDataFrame(rows, "m boolean, c boolean, s string, want int")
    assert df.where(visibility.visibility_score(F.col("m"), F.col("c"), F.col("s")) != F.col("want")).count() == 0


def test_briefs(spark):
    text = "Sure:\nTITLE: My title\nINTENT:\nSTRUCTURE:\n- one\n2. two\n\n• three"
    row = spark.createDataFrame([(text,)], "t string").select(content.parse_brief_text(F.col("t")).alias("b")).first()["b"]
    assert row["title"] == "My title" and row["structure"] == ["one", "two", "three"]
    text = "ANGLE: new\nTITLE: T\nSTRUCTURE:\n- a\n- b\nKEY_POINTS:\n- k1\n- k2\n- k3\n- k4\n- k5"
    row = spark.createDataFrame([(text,)], "t string").select(content.parse_enhancement_text(F.col("t")).alias("b")).first()["b"]
    assert (row["angle"], row["structure"], row["key_points"]) == ("new", ["a", "b"], ["k1", "k2", "k3", "k4"])
    assert spark.createDataFrame([("no title",)], "t string").select(content.parse_enhancement_text(F.col("t"))).first()[0] is None


def test_plan_and_clusters(spark):
    seeds = spark.createDataFrame(
        [("c", "Tip guide", "SEO_FIX", "high", "r", 2, "x"), ("c", "tip guide ", "CONTENT_GAP", "low", "r", 1, "x"), ("c", "ab", "CONTENT_GAP", "high", "r", 1, "x"), ("c", "guide books", "CORE_TOPIC", "medium", "r", 3, "x")],
        "crawl_run_id string, topic string, source_type string, priority string, rationale string, seed_ord int, reference string",
    )
    plan = content.plan_content(seeds)
    assert [(r["topic"], r["source_type"]) for r in plan.orderBy("place").collect()] == [("guide books", "CORE_TOPIC"), ("tip guide ", "CONTENT_GAP")]
    assert [tuple(r) for r in content.content_clusters(plan).collect()] == [("c", "Guide", ["guide books", "tip guide "])]
    assert content.content_clusters(plan.where("place = 1")).count() == 0


def test_robots(spark):
    body = "Disallow: /early\nUser-agent: a\nUser-agent: B\nDisallow: /x\nAllow: /x/y\nDisallow:\n# note\nUser-agent: *\nDisallow: /*.pdf\n"
    robots = links.parse_robots(spark.createDataFrame([("h", body)], "host string, body string"))
    urls = spark.createDataFrame([("h", f"https://h{p}") for p in ("/x/1", "/x/y/2", "/z.pdf", "/z")] + [("none", "https://none/x")], "host string, url string")
    allowed = lambda agent: {r["url"]: r["allowed"] for r in links.robots_allowed(urls, robots, agent).collect()}
    assert allowed("B/2.0") == {"https://h/x/1": False, "https://h/x/y/2": True, "https://h/z.pdf": True, "https://h/z": True, "https://none/x": True}
    assert allowed("other") == {"https://h/x/1": True, "https://h/x/y/2": True, "https://h/z.pdf": False, "https://h/z": True, "https://none/x": True}


def test_private_targets(spark):
    bad = ["localhost", "a.localhost.", "127.0.0.1", "10.1.2.3", "172.31.255.255", "192.168.0.1", "169.254.1.1", "100.64.0.1", "224.0.0.1", "::1", "fd00::1", "fe80::1", "::ffff:10.0.0.1", "2001:db8::1", ""]
    good = ["example.org", "8.8.8.8", "172.32.0.1", "100.128.0.1", "2606:4700::1", "::ffff:8.8.8.8"]
    df = spark.createDataFrame([(h,) for h in bad + good], "host string")
    assert sorted(r["host"] for r in links.private_target_filter(df).collect()) == sorted(good)


def test_page_features():
    page = """<html lang="en"><head><title> A &amp; B </title><meta name="description" content=" d "><meta name="robots" content="NOINDEX"><link rel="canonical" href="/c/"><link rel="icon" href="x"><meta property="og:title" content="p"><meta name="og:title" content="n">
    <script type="application/ld+json">{"@type": ["A", "B", 3]}</script><script type="application/ld+json">{bad</script><script src="a.js"></script></head><body><h1>Hi there</h1><a href="/x/">in</a><a href="/x">in</a><a href="https://other.org/">out</a><a href="mailto:a@b.c">m</a><img alt=" "><img alt="y"></body></html>"""
    f = html.page_features(page, "https://www.x.org/p", "x.org")
    assert (f["title"], f["meta_description"], f["canonical_url"], f["og_title"], f["is_indexable"]) == ("A & B", "d", "https://www.x.org/c", "p", False)
    assert (f["internal_links"], f["json_ld_types"], f["external_link_count"], f["image_count"], f["images_missing_alt"], f["js_file_count"], f["word_count"]) == (["https://www.x.org/x"], ["A", "B"], 2, 2, 1, 1, 2)
    assert html.page_features(None, "", "")["is_indexable"] is None


def test_malformed_payloads(spark):
    df = spark.createDataFrame([("s", x) for x in ("", "{", "[]", '{"rows": 5}', '{"rows": [null, {"keys": []}, {"keys": ["q"], "clicks": "x", "ctr": "NaN", "position": 2}]}')], "site_url string, payload string")
    assert [tuple(r)[2:] for r in payloads.flatten_query_metrics(df).collect()] == [(["q"], 0.0, 0.0, 0.0, 2.0)]
    listing = '{"data": {"children": [{"kind": "t1", "data": {}}, {"data": {"subreddit": "r", "title": " t ", "permalink": "/p", "score": -3, "created_utc": 10}}, 7, {"data": {"title": "x", "permalink": "/q"}}]}}'
    df = spark.createDataFrame([("c", "q", listing), ("c", "q", "nonsense")], "crawl_run_id string, query string, payload string")
    assert [(r["title"], r["score"], r["created_at"]) for r in payloads.map_listing_posts(df).collect()] == [("t", 0, datetime(1970, 1, 1, 0, 0, 10))]


def test_plans_and_usage(spark):
    events = spark.createDataFrame([("s1", "u", "active", datetime(2024, 1, 1), 1), ("s1", "u", "cancelled", datetime(2024, 1, 2), 2), ("s2", "u", "active", datetime(2024, 1, 1), 3)], "subscription_id string, user_id string, status string, event_ts timestamp, event_id long")
    assert jobs.subscription_state(events).first()["plan"] == "pro"
    usage = spark.createDataFrame([("u", datetime(2024, 1, 7, 23)), ("u", datetime(2024, 1, 8)), ("u", datetime(2024, 1, 14))], "user_id string, scanned_at timestamp")
    assert sorted((r["period"], r["start"].day, r["scans"], r["left"]) for r in jobs.usage_windows(usage).collect()) == [("month", 1, 3, 5), ("week", 1, 1, 1), ("week", 8, 2, 0)]


def test_users_of_subscription_events(spark):
    users = spark.createDataFrame([("u1", "a@x.org"), ("u2", "b@x.org")], "user_id string, email string")
    rows = [(1, "subscription.active", "s1", {"userId": "u1"}, "b@x.org"), (2, "subscription.active", "s2", {"user_id": "u2"}, None), (3, "subscription.active", "s3", {"userId": "gone"}, "b@x.org"), (4, "payment.ok", "s4", {}, "a@x.org"), (5, "subscription.active", "s5", {}, "no@x.org")]
    events = spark.createDataFrame(rows, "event_id long, event_type string, subscription_id string, metadata map<string,string>, customer_email string")
    assert {r["event_id"]: r["user_id"] for r in jobs.resolve_users(events, users).collect()} == {1: "u1", 2: "u2", 3: "u2"}


def test_prompts_of_briefs(spark):
    row = [("c", "o", "tip guide", "commercial", "GAP", "why", "do it", ["https://c/x", "https://c/y"], ["tip", "guide"], "angle", "Title", ["one", "two"], ["k1", "k2"]), ("c", "p", "q", "i", "GAP", "w", "d", [], [], "a", "t", [], [])]
    df = spark.createDataFrame(row, "crawl_run_id string, opportunity_id string, target_topic string, search_intent string, coverage string, opportunity string, suggested_action string, evidence_page_urls array<string>, evidence_phrases array<string>, angle string, suggested_title string, structure array<string>, key_points array<string>")
    full, bare = df.select(content.brief_prompt(F.lit("c.org")).alias("b"), content.draft_prompt(F.lit("c.org")).alias("d")).collect()
    lines = full["b"].split("\n")
    assert len(lines) == 14 and lines[1] == 'Target search query: "tip guide".' and lines[6:8] == ["Existing evidence pages: https://c/x, https://c/y", "Phrases from real content to address: tip; guide"]
    assert len(bare["b"].split("\n")) == 12
    assert full["d"].split("\n")[5:7] == ["Use this structure: 1. one 2. two", "Key points the article must address: - k1 - k2"]
