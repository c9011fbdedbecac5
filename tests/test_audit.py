import duckdb
import pytest
from pyspark.sql import functions as F

from sitemetry.operators import audit, stats
from sitemetry.plans.audit_queries import ORACLE_SQL, QUERIES

PAGES = (
    "crawl_run_id string, page_id string, page_seq long, url string, status_code int, content_type string, title string, meta_description string, canonical_url string, is_indexable boolean, word_count int, "
    "response_time_ms int, internal_links array<string>, h1_count int, h2_count int, h3_count int, h4_count int, h5_count int, h6_count int, image_count int, images_missing_alt int, json_ld_types array<string>, "
    "og_title string, og_description string, og_image string, twitter_card string, twitter_image string, server_header string, cdn_header string, has_viewport boolean, has_charset boolean, has_favicon boolean, html_lang string, js_file_count int"
)
RUNS = "crawl_run_id string, website_url string, robots_found boolean, sitemap_found boolean, pages_discovered int, pages_crawled int"


def page(n, crawl="c", **over):
    base = dict(
        crawl_run_id=crawl, page_id=f"{crawl}{n}", page_seq=n, url=f"https://x.org/{n}", status_code=200, content_type="text/html", title=f"A title of a good length, number {n:04}", meta_description=f"Description {n} " + "x" * 50,
        canonical_url=f"https://x.org/{n}", is_indexable=True, word_count=400, response_time_ms=120, internal_links=[f"https://x.org/{1 - n % 2}"], h1_count=1, h2_count=2, h3_count=0, h4_count=0, h5_count=0, h6_count=0, image_count=1,
        images_missing_alt=0, json_ld_types=["Article"], og_title="o", og_description="o", og_image="o", twitter_card="s", twitter_image="t", server_header="nginx", cdn_header=None, has_viewport=True, has_charset=True, has_favicon=True,
        html_lang="en", js_file_count=0,
    )
    return base | over


def frame(spark, rows):
    names = [c.strip().split(" ")[0] for c in PAGES.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PAGES)


def types(df):
    return sorted(r["issue_type"] for r in df.collect())


def run(spark, **over):
    base = dict(crawl_run_id="c", website_url="https://x.org", robots_found=True, sitemap_found=True, pages_discovered=2, pages_crawled=2) | over
    return spark.createDataFrame([tuple(base.values())], RUNS)


def test_a_perfect_site_scores_100_in_every_crawl(spark):
    pages = frame(spark, [page(n, c) for c in "abc" for n in (0, 1)])
    runs = run(spark, crawl_run_id="a").union(run(spark, crawl_run_id="b")).union(run(spark, crawl_run_id="c"))
    assert audit.all_issues(pages, runs).count() == 0
    assert {r["crawl_run_id"]: r["health_score"] for r in audit.health_score(pages, runs).collect()} == dict.fromkeys("abc", 100)


@pytest.mark.parametrize(
    ("over", "want"),
    [
        (dict(title=None), ["MISSING_TITLE"]),
        (dict(title="  short "), ["TITLE_TOO_SHORT"]),
        (dict(title="x" * 61), ["TITLE_TOO_LONG"]),
        (dict(meta_description=" "), ["MISSING_META_DESCRIPTION"]),
        (dict(canonical_url=None), ["MISSING_CANONICAL"]),
        (dict(is_indexable=False), ["NOINDEX_PAGE"]),
        (dict(is_indexable=None), []),
        (dict(h1_count=0), ["MISSING_H1"]),
        (dict(h1_count=3), []),
        (dict(images_missing_alt=1), ["IMAGES_MISSING_ALT"]),
        (dict(og_title=None, og_description=""), ["MISSING_OG_TAGS"]),
        (dict(has_viewport=False, has_charset=None, has_favicon=False), ["MISSING_CHARSET", "MISSING_FAVICON", "MISSING_VIEWPORT"]),
        (dict(html_lang=""), ["MISSING_HTML_LANG"]),
        (dict(html_lang=" "), []),
        (dict(word_count=299, response_time_ms=3001), ["SLOW_RESPONSE", "THIN_CONTENT"]),
        (dict(word_count=None, response_time_ms=None), []),
        (dict(status_code=404, title=None), []),
        (dict(content_type=None, title=None), []),
        (dict(content_type="application/xhtml+xml", title=None), ["MISSING_TITLE"]),
    ],
)
def test_page_issues(spark, over, want):
    assert types(audit.page_issues(frame(spark, [page(1, **over)]))) == want


def test_duplicates_links_and_status(spark):
    same = "The very same title on all of these pages"
    rows = [page(0, title=same), page(1, title=f" {same} ", internal_links=["https://x.org/2", "https://x.org/9"]), page(2, status_code=404, title=same), page(3, status_code=0), page(4, status_code=500), page(5, status_code=None), page(6, status_code=301)]
    pages = frame(spark, rows + [page(7, "other", title=same)])
    dup = audit.duplicate_value_issues(pages).collect()
    assert [(r["issue_type"], r["message"]) for r in dup] == [("DUPLICATE_TITLE", f'Duplicate title "{same}" on 2 pages')]
    assert [r["message"] for r in audit.broken_link_issues(pages).collect()] == ["Broken internal link to https://x.org/2 (HTTP 404)"]
    assert sorted((r["page_id"], r["severity"]) for r in audit.non_200_issues(pages).collect()) == [("c2", "warning"), ("c3", "error"), ("c4", "error")]


@pytest.mark.parametrize(
    ("statuses", "want"),
    [
        ([404, None], ["Broken internal link to https://x.org/t (HTTP 404)"]),
        ([None, 0, None, None], ["Broken internal link to https://x.org/t (fetch failed)"]),
        ([404, 200, None], []),
        ([200, 500], ["Broken internal link to https://x.org/t (HTTP 500)"]),
        ([None, None], []),
    ],
)
def test_a_link_takes_the_last_known_status_of_its_target(spark, statuses, want):
    target = "https://x.org/t"
    pages = frame(spark, [page(0, internal_links=[target]), *(page(n, url=target, status_code=s, content_type=None) for n, s in enumerate(statuses, 1))])
    assert [r["message"] for r in audit.broken_link_issues(pages).collect()] == want
    facts = audit.link_facts(pages).first()
    assert (facts["n_broken"], facts["n_known_targets"], facts["n_urls"]) == (len(want), 1, 2)


@pytest.mark.parametrize("extra", [[(20, "https://x.example.org/t"), (23, "https://x.example.org/t")], [(9, None)]], ids=["crawled again without status", "without url"])
def test_html_health_score_equals_its_sql(spark, tmp_path, extra):
    html = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>A title of a good length, not too long</title></head><body><a href="/t">t</a></body></html>'
    rows = [(n, url, html) for n, url in [(n, f"https://x.example.org/{n}") for n in (5, 6, 7, 8)] + extra]  # status of 20: 404, of 23: none
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert [tuple(r) for r in QUERIES["html_health_score"](spark, str(tmp_path)).collect()] == duck.execute(ORACLE_SQL["html_health_score"]).fetchall()


@pytest.mark.parametrize(
    ("over", "js", "words", "want"),
    [
        (dict(pages_discovered=0, pages_crawled=0), 0, 1, "FAILED"),
        (dict(pages_discovered=5, pages_crawled=0, robots_found=False), 0, 1, "RESTRICTED"),
        (dict(pages_discovered=5, pages_crawled=0), 0, 1, "FAILED"),
        (dict(pages_discovered=100, pages_crawled=10), 0, 1, "PARTIAL"),
        (dict(), 2, 0, "LIMITED_RENDERING"),
        (dict(), 0, 0, "COMPLETED"),
    ],
)
def test_crawl_state(spark, over, js, words, want):
    pages = frame(spark, [page(1, js_file_count=js, word_count=words)])
    assert audit.crawl_state(pages, run(spark, **over)).first()["crawl_state"] == want
    if want in ("FAILED", "RESTRICTED"):
        assert audit.health_score(pages, run(spark, **over)).first()["health_score"] == 0


def test_histogram_and_counts(spark):
    pages = frame(spark, [page(n, response_time_ms=ms) for n, ms in enumerate((None, 499, 500, 3000, 2999))])
    assert {r["bucket"]: r["pages"] for r in stats.response_time_histogram(pages).collect()} == {"under500": 1, "500to1000": 1, "1000to2000": 0, "2000to3000": 1, "over3000": 2}
    counts = audit.issue_counts(audit.all_issues(pages, run(spark)), run(spark))
    assert counts.count() == 25 and counts.where(F.col("issue_count") < 0).count() == 0
