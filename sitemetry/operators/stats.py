"""Statistics of a crawl's pages. ``crawl_overview`` takes them all in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

BUCKETS = ["under500", "500to1000", "1000to2000", "2000to3000", "over3000"]


def _given(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _mean(value: Column) -> Column:
    """A mean rounded half away from zero to an integer."""
    return F.round(F.avg(value)).cast("int")


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def heading_columns() -> dict[str, Column]:
    out = {f"total_h{k}": _sum(f"h{k}_count") for k in range(1, 7)}
    return out | {"pages_with_h1": _count(F.col("h1_count") > 0), "pages_with_multiple_h1": _count(F.col("h1_count") > 1)}


def image_columns() -> dict[str, Column]:
    return {
        "total_images": _sum("image_count"),
        "total_missing_alt": _sum("images_missing_alt"),
        "pages_with_images": _count(F.col("image_count") > 0),
        "pages_without_images": _count(F.coalesce(F.col("image_count"), F.lit(0)) == 0),
    }


def structured_data_columns() -> dict[str, Column]:
    some = F.size("json_ld_types") > 0
    return {
        "total_schema_types": F.coalesce(F.sum(F.when(some, F.size("json_ld_types"))), F.lit(0)).cast("bigint"),
        "schema_types": F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(some, F.col("json_ld_types")))))),
        "pages_with_schema": _count(some),
        "pages_without_schema": _count(~F.coalesce(some, F.lit(False))),
    }


def social_columns() -> dict[str, Column]:
    return {
        "pages_with_og": _count(_given("og_title") | _given("og_description")),
        "pages_with_twitter": _count(_given("twitter_card")),
        "pages_with_og_image": _count(_given("og_image")),
        "pages_with_twitter_image": _count(_given("twitter_image")),
    }


def performance_columns() -> dict[str, Column]:
    ms = F.col("response_time_ms")
    return {"avg_response_ms": _mean(ms), "max_response_ms": F.max(ms), "min_response_ms": F.min(ms), "avg_words": _mean(F.col("word_count")), "slow_pages": _count(ms > R.SLOW_MS)}


def page_columns() -> dict[str, Column]:
    html = F.contains("content_type", F.lit("text/html"))
    return {
        "total_pages": F.count(F.lit(1)),
        "http_200": _count(F.col("status_code") == 200),
        "with_title": _count(_given("title")),
        "with_meta": _count(_given("meta_description")),
        "with_canonical": _count(_given("canonical_url")),
        "with_viewport": _count(F.col("has_viewport")),
        "with_charset": _count(F.col("has_charset")),
        "with_favicon": _count(F.col("has_favicon")),
        "with_lang": _count(_given("html_lang")),
        "indexable": _count(F.coalesce(F.col("is_indexable"), F.lit(True))),
        "non_indexable": _count(~F.col("is_indexable")),
        "html_pages": _count(html),
        "non_html_pages": _count(~F.coalesce(html, F.lit(False))),
        "thin_content": _count(F.col("word_count") < R.THIN_WORDS),
    }


def title_columns() -> dict[str, Column]:
    n = F.length("title")
    return {
        "avg_title": _mean(n),
        "min_title": F.min(n),
        "max_title": F.max(n),
        "short_titles": _count((n < R.TITLE_MIN) & (n > 0)),
        "long_titles": _count(n > R.TITLE_MAX),
        "missing_titles": _count(~_given("title")),
    }


def meta_columns() -> dict[str, Column]:
    return {"avg_meta": _mean(F.length("meta_description")), "missing_meta": _count(~_given("meta_description"))}


def word_columns() -> dict[str, Column]:
    w = F.col("word_count")
    return {"avg_word_count": _mean(w), "min_word_count": F.min(w), "max_word_count": F.max(w), "thin_pages": _count(w < R.THIN_WORDS), "zero_word_pages": _count(F.coalesce(w, F.lit(0)) == 0)}


def link_columns() -> dict[str, Column]:
    n = F.nullif(F.greatest(F.size("internal_links"), F.lit(0)), F.lit(0))
    return {"avg_links": _mean(n), "max_links": F.max(n), "zero_link_pages": _count(n.isNull()), "few_link_pages": _count((n > 0) & (n < 3))}


def _by_crawl(pages: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return pages.groupBy("crawl_run_id").agg(*[c.alias(name) for name, c in columns.items()])


def heading_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, heading_columns())


def image_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, image_columns())


def structured_data_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, structured_data_columns())


def social_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, social_columns())


def performance_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, performance_columns())


def page_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, page_columns())


def title_length_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, title_columns())


def meta_length_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, meta_columns())


def word_count_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, word_columns())


def internal_link_stats(pages: DataFrame) -> DataFrame:
    return _by_crawl(pages, link_columns())


def server_columns() -> dict[str, Column]:
    names = lambda c: F.array_sort(F.collect_set(F.when(_given(c), F.col(c))))
    return {"servers": names("server_header"), "cdns": names("cdn_header")}


def server_info(pages: DataFrame) -> DataFrame:
    """Distinct servers and CDNs of a crawl; both sets are small."""
    return _by_crawl(pages, server_columns())


def crawl_overview(pages: DataFrame) -> DataFrame:
    """All statistics of a crawl as one wide row, from one scan."""
    columns: dict[str, Column] = {}
    for part in (heading_columns, image_columns, structured_data_columns, social_columns, performance_columns, page_columns, title_columns, meta_columns, word_columns, link_columns, server_columns):
        columns |= part()
    return _by_crawl(pages, columns)


def response_time_histogram(pages: DataFrame) -> DataFrame:
    """Pages in each of five buckets, zeros included; unknown times count as slowest."""
    ms = F.col("response_time_ms")
    bucket = F.when(ms < 500, BUCKETS[0]).when(ms < 1000, BUCKETS[1]).when(ms < 2000, BUCKETS[2]).when(ms < 3000, BUCKETS[3]).otherwise(BUCKETS[4])
    counts = pages.groupBy("crawl_run_id").agg(*[_count(bucket == b).alias(b) for b in BUCKETS])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("pages")) for b in BUCKETS]))
    return counts.select("crawl_run_id", rows.alias("r")).select("crawl_run_id", "r.bucket", "r.pages")


def http_status_distribution(pages: DataFrame) -> DataFrame:
    return pages.where("status_code is not null").groupBy("crawl_run_id", "status_code").agg(F.count(F.lit(1)).alias("pages"))


def content_page_health(pages: DataFrame) -> DataFrame:
    """Thin, well-headed, unlinked and titled HTML pages, as counts and JS-rounded shares."""
    html = pages.where(R.is_html(F.col("content_type")))
    n = F.count(F.lit(1))
    links = F.coalesce(F.size("internal_links"), F.lit(-1)) <= 0
    parts = {
        "thin": _count(F.coalesce(F.col("word_count"), F.lit(0)) < R.THIN_WORDS),
        "good_headings": _count((F.col("h1_count") == 1) & (F.col("h2_count") >= 2)),
        "unlinked": _count(links),
        "titled": _count(_given("title")),
    }
    counted = html.groupBy("crawl_run_id").agg(n.alias("html_pages"), *[c.alias(k) for k, c in parts.items()])
    return counted.select("*", *[F.floor(F.col(k) / F.col("html_pages") * 100 + 0.5).cast("int").alias(f"{k}_pct") for k in parts])


def coverage_rates(pages: DataFrame) -> DataFrame:
    """Shares of pages with a canonical and of images with alt text (100 without images)."""
    a = pages.groupBy("crawl_run_id").agg(F.count(F.lit(1)).alias("n"), _count(_given("canonical_url")).alias("c"), _sum("image_count").alias("i"), _sum("images_missing_alt").alias("m"))
    share = lambda x, n: F.floor(x / n * 100 + 0.5).cast("int")
    return a.select("crawl_run_id", share(F.col("c"), F.col("n")).alias("canonical_pct"), F.when(F.col("i") == 0, 100).otherwise(share(F.col("i") - F.col("m"), F.col("i"))).alias("alt_pct"))
