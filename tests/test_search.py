import random
from datetime import datetime

from pyspark.sql import functions as F

from sitemetry.functions import rules as R
from sitemetry.functions.text import query_tokens, significant_tokens, term_candidates
from sitemetry.operators import metrics, opportunities, topics

from .test_audit import frame, page


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(column).first()[0]


def test_intents(spark):
    cases = {"acme corp": "navigational", "best tip tool": "commercial", "tips for beginners": "commercial", "tip calculator": "transactional", "how to tip": "informational", "anything": "informational"}
    for query, want in cases.items():
        assert value(spark, R.classify_intent(F.col("q"), F.lit("acme-corp")), q=query) == want


def test_tokens_and_terms(spark):
    assert value(spark, significant_tokens(F.col("t")), t="The BEST résumé-builder for 2024 students, about us") == ["best", "-builder", "students"]
    assert value(spark, term_candidates(F.split("t", " ")), t="a b c") == ["a", "b", "c", "a b", "b c"]
    assert value(spark, term_candidates(F.split("t", " ")), t="a") == ["a"]


def test_match_scores(spark):
    score = metrics.query_match_score(query_tokens(F.col("a")), query_tokens(F.col("b")))
    cases = [("Tip calculator", "tip  calculator!", 1.0), ("tip", "tip calculator", 0.8), ("tip calculator", "tip", 0.7), ("a b", "b c", 1 / 3), ("", "x", 0.0), ("a a b", "a c", 2 / 3)]
    for a, b, want in cases:
        assert abs(value(spark, score, a=a, b=b) - want) < 1e-12


def test_enrichment_of_the_worked_example(spark):
    o = spark.createDataFrame([("c", "o1", "tip calculator", 50), ("c", "o2", "unrelated words", 40)], "crawl_run_id string, opportunity_id string, query string, score int")
    m = spark.createDataFrame([("c", 0, "tip calculator", 10.0, 100.0, 5.0), ("c", 1, "calculator tip", 2.0, 20.0, 9.0), ("c", 2, "nothing here", 5.0, 50.0, 1.0)], "crawl_run_id string, row_ord int, query string, clicks double, impressions double, position double")
    got = {r["opportunity_id"]: r for r in metrics.enrich_opportunities(o, m).collect()}
    assert (got["o1"]["clicks"], got["o1"]["impressions"], got["o1"]["ctr"], got["o1"]["position"], got["o1"]["queries"]) == (12.0, 120.0, 0.1, 5.7, ["tip calculator", "calculator tip"])
    assert got["o2"]["clicks"] is None
    assert metrics.metrics_summary(o, m).first()["queries_matched"] == 2


def test_token_join_loses_no_match(spark):
    """Against all pairs, on random queries: each row's best opportunity and its ties."""
    r = random.Random(1)
    text = lambda: " ".join(r.choice("abcdef") for _ in range(r.randrange(1, 4)))
    ops = [("c", f"o{i}", text(), r.randrange(3)) for i in range(25)]
    rows = [("c", i, text(), 1.0, 1.0, 1.0) for i in range(60)]

    def score(a, b):
        a, b = a.split(), b.split()
        if a == b:
            return 1.0
        if set(a) <= set(b):
            return 0.8
        if set(b) <= set(a):
            return 0.7
        return sum(x in b for x in a) / len(set(a) | set(b))

    want = {}
    for _, i, q, *_ in rows:
        best = sorted((-score(o[2], q), o[3], o[1]) for o in ops)[0]
        if -best[0] >= 0.6:
            want[i] = best[2]
    o = spark.createDataFrame(ops, "crawl_run_id string, opportunity_id string, query string, score int")
    m = spark.createDataFrame(rows, "crawl_run_id string, row_ord int, query string, clicks double, impressions double, position double")
    assert {x["row_ord"]: x["opportunity_id"] for x in metrics.match_queries(o, m).collect()} == want


def test_best_topic_is_the_best_of_all_core_topics(spark):
    r = random.Random(2)
    vocabulary = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot"]
    rows = [page(n, c, title=" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 6))), meta_description=None, url=f"https://x.org/{n}") for c in "ab" for n in range(15)]
    profiles = topics.page_profiles(frame(spark, rows))
    core = topics.core_topics(topics.extract_topics(topics.topic_pages(profiles)))
    ranked = {}
    for t in core.orderBy("topic_rank").collect():
        ranked.setdefault(t["crawl_run_id"], []).append(t["term"])
    want = {}
    for p in profiles.select("crawl_run_id", "page_id", "all_tokens").collect():
        fit = [t for t in ranked.get(p["crawl_run_id"], []) if set(t.split()) <= set(p["all_tokens"])]
        if fit:
            want[p["page_id"]] = fit[0]
    assert {x["page_id"]: x["best_term"] for x in topics.best_topics(profiles, core).collect()} == want


def test_ranked_opportunities_keep_their_invariants(spark):
    rows = [page(n, c, title=f"Best garden tools guide number {n}", meta_description=None, word_count=100 + n, internal_links=[]) for c in "ab" for n in range(9)]
    found = opportunities.rank_opportunities(frame(spark, rows)).collect()
    by = {}
    for r in found:
        assert r["score"] == r["relevance"] + r["impact"] + r["confidence"] and 0 <= r["score"] <= 100
        by.setdefault(r["crawl_run_id"], []).append((r["opportunity_type"], r["query"], r["score"]))
    assert sorted(by["a"]) == sorted(by["b"])  # crawls don't touch each other
    assert len(by["a"]) <= 12 and max(sum(t == x for t, *_ in by["a"]) for x, *_ in by["a"]) <= 4


def test_sites_and_snapshots(spark):
    projects = spark.createDataFrame([("p1", 1, "www.x.org", None), ("p2", 1, "y.org", "set"), ("p3", 2, "x.org", None)], "project_id string, user_id int, domain string, site_url string")
    sites = spark.createDataFrame([(1, "sc-domain:x.org"), (1, "https://www.x.org/"), (1, "junk")], "user_id int, site_url string")
    assert [tuple(r) for r in metrics.link_sites(projects, sites).collect()] == [("p1", 1, "sc-domain:x.org")]
    snaps = spark.createDataFrame([("a", datetime(2024, 1, 1, 6)), ("b", datetime(2024, 1, 1, 5, 59))], "site_url string, fetched_at timestamp")
    got = metrics.snapshot_freshness(spark.createDataFrame([("a",), ("b",), ("c",)], "site_url string"), snaps, datetime(2024, 1, 1, 12))
    assert {r["site_url"]: r["stale"] for r in got.collect()} == {"a": False, "b": True, "c": True}


def test_first_unlinked_pairs_of_any_topic_size(spark):
    """Against all pairs: random links, and topics whose first 70 pages link each other."""
    r = random.Random(4)
    pages, hits, core = [], [], []
    for c, (n, share, menu) in enumerate([(9, 0.5, 0), (9, 0.9, 0), (8, 1.0, 0), (75, 0.0, 70), (73, 0.0, 72), (5, 0.0, 0)]):
        for t in range(2):
            ids = [f"{t}-{i:03}" for i in range(n)]
            core.append((f"c{c}", f"t{t}", n, n, t + 1))
            for i, x in enumerate(ids):
                links = [f"u{y}" for j, y in enumerate(ids) if j != i and (r.random() < share or (i < menu and j < menu))]
                pages.append((f"c{c}", x, f"u{x}", links or None))
                hits.append((f"c{c}", f"t{t}", x, 100 * t + i, True))
    profiles = spark.createDataFrame(pages, "crawl_run_id string, page_id string, url string, internal_links array<string>")
    on_pages = spark.createDataFrame(hits, "crawl_run_id string, term string, page_id string, page_seq int, dedicated boolean")
    topics_ = spark.createDataFrame(core, "crawl_run_id string, term string, doc_freq int, dedicated_pages int, topic_rank int")
    links = {(c, p): set(x or []) for c, p, _, x in pages}
    want = []
    for c in sorted({x[0] for x in pages}):
        found = [(c, t, a, b) for (d, t, a, i, _) in hits if d == c for (e, u, b, j, _) in hits if e == c and u == t and i < j and f"u{b}" not in links[c, a] and f"u{a}" not in links[c, b]]
        want += found[:2]
    got = opportunities.unlinked_topic_pairs(profiles, on_pages, topics_).orderBy("crawl_run_id", "gen_ord").collect()
    assert [(x["crawl_run_id"], x["query"], *(e["id"] for e in x["evidence_pages"])) for x in got] == want


def test_first_link_suggestions_of_any_topic_size(spark):
    from sitemetry.operators import content
    from sitemetry.operators.links import link_key

    plan = spark.createDataFrame([("c", 1, "alpha"), ("c", 2, "alphabet"), ("d", 1, "alpha")], "crawl_run_id string, place int, topic string")
    n = 74
    pages = [(c, i, f"https://x.org/{c}{i:03}", "alpha" if c == "d" or i % 2 or i < 60 else "alphabet") for c in "cd" for i in range(n)]
    df = spark.createDataFrame(pages, "crawl_run_id string, page_seq int, url string, title string")
    keys = {(r["crawl_run_id"], r["page_seq"]): r["k"] for r in df.withColumn("k", link_key(F.col("url"))).collect()}
    linked = {(c, i, j) for c in "cd" for i in range(n) for j in range(n) if i != j and (max(i, j) < 71 or (c == "c" and max(i, j) < 73))}
    edges = spark.createDataFrame([(c, keys[c, i], keys[c, j]) for c, i, j in linked], "crawl_run_id string, source string, target string")
    want = []
    for c in "cd":
        seen = []
        for t in ("alpha", "alphabet") if c == "c" else ("alpha",):
            has = [i for d, i, _, title in pages if d == c and t in title]
            for i in has:
                for j in has:
                    if i < j and (c, i, j) not in linked and (i, j) not in [s[:2] for s in seen]:
                        seen.append((i, j, t))
        want += [(c, k + 1, keys[c, i], keys[c, j], t) for k, (i, j, t) in enumerate(seen[:8])]
    assert sorted(map(tuple, content.content_link_suggestions(plan, df, edges).collect())) == want


def test_pages_are_read_once(spark):
    """The widest queries scan the given tables at most three times in all."""
    from sitemetry.plans import registry

    for name in ("rank_opportunities", "enrich_opportunities", "plan_content", "content_link_suggestions"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= 3, name


def test_queries_match_over_all_pairs(spark):
    """The join on the first shared token finds what a comparison of all pairs finds."""
    import random

    from sitemetry.operators import metrics

    r = random.Random(3)
    phrase = lambda: " ".join(r.choice("red blue green big small cat dog".split()) for _ in range(r.randrange(0, 5)))
    o = [("c", f"o{i:02}", phrase(), r.randrange(5)) for i in range(40)]
    m = [("c", i, phrase(), float(i)) for i in range(60)]
    got = metrics.match_queries(spark.createDataFrame(o, "crawl_run_id string, opportunity_id string, query string, score int"), spark.createDataFrame(m, "crawl_run_id string, row_ord int, query string, clicks double"))

    def score(a, b):
        a, b = a.split(), b.split()
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        if all(x in b for x in a):
            return 0.8
        if all(x in a for x in b):
            return 0.7
        return sum(x in b for x in a) / len(set(a) | set(b))

    want = {}
    for _, k, q, _ in m:
        s, _, best = min((-score(p, q), sc, i) for _, i, p, sc in o)
        if -s >= 0.6:
            want[k] = (best, -s)
    assert {x["row_ord"]: (x["opportunity_id"], x["match_score"]) for x in got.collect()} == want
