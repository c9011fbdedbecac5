import json
from datetime import datetime

from sitemetry.sources import payloads


def frame(spark, keys, rows):
    return spark.createDataFrame([(*k, json.dumps(p) if not isinstance(p, str) else p) for k, p in rows], ", ".join(f"{k} string" for k in [*keys, "payload"]))


def test_metric_rows_keep_json_types(spark):
    rows = [
        {"keys": ["a", 5, None, True, "b"], "clicks": "7", "impressions": True, "ctr": "x", "position": 1.5},
        {"keys": [9]},
        "text",
        None,
        [1],
        {"keys": "a"},
        {"keys": ["c"], "clicks": None, "position": " 2 "},
    ]
    got = payloads.flatten_query_metrics(frame(spark, ["site_url"], [(("s",), {"rows": rows}), (("t",), "no json"), (("u",), {"rows": 5}), (("v",), {})])).collect()
    assert sorted((r["site_url"], r["row_ord"], r["keys"], r["clicks"], r["impressions"], r["ctr"], r["position"]) for r in got) == [
        ("s", 0, ["a", "b"], 7.0, 1.0, 0.0, 1.5),
        ("s", 6, ["c"], 0.0, 0.0, 0.0, 2.0),
    ]


def test_metric_sites(spark):
    sites = [{"siteUrl": " https://a/ "}, {"siteUrl": 5}, {"siteUrl": " "}, "x", None, {"siteUrl": "https://a/"}]
    df = frame(spark, ["user_id"], [(("1",), {"siteEntry": sites}), (("2",), {"siteEntry": {}}), (("3",), "[]")])
    assert [tuple(r) for r in payloads.flatten_metric_sites(df).collect()] == [("1", "https://a/")]


def test_listing_posts_keep_json_types(spark):
    good = {"subreddit": " s ", "title": " T ", "permalink": "/r/s/1", "author": " me ", "score": 3.5, "num_comments": "4", "created_utc": 60, "selftext": " b "}
    children = [
        {"kind": "t3", "data": good},
        {"kind": 7, "data": good | {"score": -3, "num_comments": 2.4, "author": "[deleted]", "created_utc": "60", "selftext": 5}},
        {"kind": "t1", "data": good},
        {"data": good | {"title": 5}},
        {"data": good | {"title": "[removed] "}},
        {"data": good | {"permalink": "r/s"}},
        {"data": good | {"subreddit": None}},
        {"data": "x"},
        "x",
        None,
        {"data": good | {"author": None, "score": "12"}},
    ]
    df = frame(spark, ["crawl_run_id", "query"], [(("c", "q"), {"data": {"children": children}}), (("d", "q"), {"data": 5}), (("e", "q"), "[]")])
    got = [tuple(r) for r in payloads.map_listing_posts(df).orderBy("post_ord").collect()]
    at = datetime(1970, 1, 1, 0, 1)
    assert got == [
        ("c", "q", 0, "s", "T", "/r/s/1", " me ", 4, 0, at, "b"),
        ("c", "q", 1, "s", "T", "/r/s/1", None, 0, 2, None, None),
        ("c", "q", 10, "s", "T", "/r/s/1", None, 0, 0, at, "b"),
    ]


def test_flat_items_keep_json_types(spark):
    post = {"type": "post", "id": "p1", "subreddit": "s", "title": "T", "url": "https://x.test/r/s/1", "author": " me ", "score": 2, "numComments": "3", "created": 1_700_000_000}
    items = [
        post,
        {"type": "comment", "postId": "p1", "body": " hi ", "author": "[deleted]", "score": "5", "created": "2024-01-02T00:00:00Z"},
        {"type": "comment", "postId": 1, "body": "lost"},
        {"type": "comment", "postId": "p1", "body": 5},
        post | {"permalink": 5},
        post | {"title": 5},
        post | {"id": 5, "permalink": "https://x.test/r/s/2", "created": 1_700_000_000_000, "score": "9"},
        "x",
        None,
    ]
    got = payloads.map_flat_items(frame(spark, ["crawl_run_id", "query"], [(("c", "q"), items), (("d", "q"), {})])).orderBy("post_ord").collect()
    assert [(r["post_ord"], r["permalink"], r["author"], r["score"], r["num_comments"], str(r["created_at"])) for r in got] == [
        (0, "/r/s/1", "me", 2, 0, "2023-11-14 22:13:20"),
        (6, "/r/s/2", "me", 0, 0, "2023-11-14 22:13:20"),
    ]
    assert [(c["author"], c["body"], c["score"], str(c["created_at"])) for c in got[0]["comments"]] == [(None, "hi", 0, "2024-01-02 00:00:00")] and got[1]["comments"] is None


URLS = {
    "HTTP://User:pw@Example.COM:80/a/../b//c/./d/?q=a b#f": "http://User:pw@example.com/b//c/d?q=a%20b",
    "https://example.com:8443": "https://example.com:8443/",
    "https://example.com/%2E%2e/x/..": "https://example.com/",
    "https://example.com/é ü/{x}": "https://example.com/%C3%A9%20%C3%BC/%7Bx%7D",
    "https://example.com/a%2fb%20c///": "https://example.com/a%2fb%20c",
    "https://example.com/?": "https://example.com/?",
    "https://example.com?a='b'": "https://example.com/?a=%27b%27",
    "ftp://example.com/x": None,
    "no url": None,
    "https:///x": None,
}


def test_urls_are_normalised_alike_in_columns_and_in_the_parser(spark):
    from pyspark.sql import functions as F

    from sitemetry.functions import urls
    from sitemetry.sources import html

    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r["url"]: r["n"] for r in df.select("url", urls.norm_crawl_url(F.col("url")).alias("n")).collect()} == URLS
    assert {u: html.normal_url(u) for u in URLS} == URLS


def test_redirects_inside_the_domain(spark):
    from pyspark.sql import functions as F

    from sitemetry.functions import urls

    base = "https://www.example.com/a/b?x=1"
    cases = {"/c/": "https://www.example.com/c/", "c/../d/": "https://www.example.com/a/d/", "..": "https://www.example.com/", "?y#z": "https://www.example.com/a/b?y", "": base, "//m.example.com/x/": "https://m.example.com/x/", "https://other.org/": None, "mailto:a@example.com": None, "https://example.com/a/.": "https://example.com/a/"}
    df = spark.createDataFrame([(c,) for c in cases], "location string")
    got = {r["location"]: r["t"] for r in df.select("location", urls.redirect_target(F.col("location"), F.lit(base), F.lit("example.com")).alias("t")).collect()}
    assert got == cases
