"""Incremental jobs. Each has a batch twin with the same rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules as R
from ..sources import versioned
from ..sources.versioned import latest_by

WEEKLY_SCANS, MONTHLY_SCANS, POSTS_PER_SCAN, MONTHLY_POSTS = 2, 8, 10, 40
DAY_MS = 86_400_000


def _facts(fetches: DataFrame) -> DataFrame:
    """(crawl_run_id, url, fetched_at, fetched, status): a row for each fetch, and one for each URL that a fetch makes known."""
    content = F.col("url").isNull() | R.is_content_page(F.col("status_code"), F.col("content_type"))
    fact = lambda url, fetched, status: F.struct(url.alias("url"), F.lit(fetched).alias("fetched"), status.cast("bigint").alias("status"))
    own = F.filter(F.array(fact(F.col("url"), True, F.coalesce("status_code", F.lit(-1)))), lambda f: f["url"].isNotNull())
    linked = F.transform(F.array_distinct(F.coalesce("internal_links", F.array().cast("array<string>"))), lambda u: fact(u, False, F.lit(-1)))
    every = F.when(content, F.concat(own, linked)).otherwise(own)
    return fetches.where("fetched_at is not null").select("crawl_run_id", "fetched_at", F.explode(every).alias("f")).select("crawl_run_id", "f.url", "fetched_at", "f.fetched", "f.status").where("crawl_run_id is not null and url is not null")


def crawl_counters(fetches: DataFrame) -> DataFrame:
    """(crawl_run_id, crawled, ok, discovered) of each run: URLs fetched, those whose first fetch was fine, URLs known.

    ``fetches``: (crawl_run_id, url, status_code, content_type, internal_links, fetched_at). Links of
    content pages make URLs known; a row without a url announces the start page and sitemaps' URLs as
    its links. Every URL counts once, with the least (fetched_at, status) of its fetches. Rows without
    a run or a time are left out.
    """
    by_url = _facts(fetches).groupBy("crawl_run_id", "url").agg(F.min(F.when(F.col("fetched"), F.struct("fetched_at", "status"))).alias("first"), F.bool_or(~F.col("fetched")).alias("known"))
    return by_url.groupBy("crawl_run_id").agg(F.count("first").alias("crawled"), F.count_if(F.col("first.status") == 200).alias("ok"), F.count_if("known").alias("discovered"))


_DELTA = "crawl_run_id string, crawled bigint, ok bigint, discovered bigint"


def _bucket_changes(keep_ms: int):
    """What new facts about the URLs of a bucket add to their runs' counters, from what is remembered of them."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        urls = {(run, url): tuple(rest) for run, url, *rest in json.loads(state.get[0])} if state.exists else {}
        before: dict[tuple, tuple] = {}
        for frame in frames:
            for run, url, micros, fetched, code in zip(*[frame[c].tolist() for c in ("crawl_run_id", "url", "micros", "fetched", "status")], strict=True):
                at, status, known, last = urls.get((run, url), (None, None, False, micros))
                before.setdefault((run, url), (at is not None, status == 200, known))
                if not fetched:
                    known = True
                elif at is None or (micros, code) < (at, status):
                    at, status = micros, code
                urls[run, url] = at, status, known, max(last, micros)
        watermark, changes = state.getCurrentWatermarkMs(), {}
        for one, was in before.items():
            at, status, known, _ = urls[one]
            counts = changes.setdefault(one[0], [0, 0, 0])
            for k, (new, old) in enumerate(zip((at is not None, status == 200, known), was, strict=True)):
                counts[k] += new - old
        urls = {one: told for one, told in urls.items() if one in before or told[3] // 1000 + keep_ms >= watermark}
        state.update((json.dumps([[*one, *told] for one, told in urls.items()], ensure_ascii=False, separators=(",", ":")),))
        state.setTimeoutTimestamp(max(max(told[3] for told in urls.values()) // 1000 + keep_ms, watermark + 1))
        changed = [[run, *counts] for run, counts in changes.items() if any(counts)]
        if changed:
            yield pd.DataFrame(changed, columns=[c.split()[0] for c in _DELTA.split(", ")])

    return fold


#: Groups that the URLs of a stream's state are dealt into: Python is called for a bucket, not for a URL.
URL_BUCKETS = 16_384


def stream_crawl_counters(fetches: DataFrame, path: str, checkpoint: str, days: int = 7, buckets: int = URL_BUCKETS):
    """``crawl_counters`` over a stream of fetches in any order; read it with ``counters_so_far``.

    The state holds two sets of URLs, those fetched (with their first fetch so far) and those known, in
    buckets by a hash of run and URL, so a large run is spread. A micro-batch writes the buckets that it
    touches again, so ``buckets`` should grow with the URLs remembered; it is fixed for a checkpoint. A
    fetch before the first one seen corrects what was counted. A URL is remembered for ``days`` behind
    the watermark at least, which is ``days`` late itself: rows later than that are dropped. URLs that
    are over go with the next change of their bucket, or with the bucket. Micro-batch n writes what it
    changes to the folder ``batch=n``, so a batch that is repeated after a failure counts once.
    """
    facts = _facts(fetches.withWatermark("fetched_at", f"{days} days")).withColumn("micros", F.unix_micros("fetched_at")).withColumn("bucket", versioned.bucket_of(["crawl_run_id", "url"], buckets))
    changes = facts.groupBy("bucket").applyInPandasWithState(_bucket_changes(days * DAY_MS), _DELTA, "urls string", "append", GroupStateTimeout.EventTimeTimeout)

    def add(batch: DataFrame, batch_id: int) -> None:
        counters_so_far(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def counters_so_far(changes: DataFrame) -> DataFrame:
    """(crawl_run_id, crawled, ok, discovered) from what ``stream_crawl_counters`` wrote."""
    return changes.groupBy("crawl_run_id").agg(*[F.sum(c).alias(c) for c in ("crawled", "ok", "discovered")])


def usage_windows(scans: DataFrame) -> DataFrame:
    """(user_id, period, start, scans, most, left, conversations) by ISO week and calendar month.

    ``scans`` holds (user_id, scanned_at). Weeks start on Monday, 00:00 UTC.
    """
    return _windows(scans.select("user_id", "scanned_at", F.lit(1).cast("bigint").alias("scans")), F.col("scanned_at"))


def _windows(counts: DataFrame, at: Column) -> DataFrame:
    """Rows as of ``usage_windows`` from (user_id, scans) at a time."""
    periods = F.array(*[F.struct(F.lit(p).alias("period"), F.date_trunc(p, at).alias("start")) for p in ("week", "month")])
    counted = counts.select("user_id", "scans", F.explode(periods).alias("p")).groupBy("user_id", "p.period", "p.start").agg(F.sum("scans").alias("scans"))
    most = F.when(F.col("period") == "week", WEEKLY_SCANS).otherwise(MONTHLY_SCANS)
    talks = F.when(F.col("period") == "month", F.least(F.lit(MONTHLY_POSTS), F.col("scans") * POSTS_PER_SCAN).cast("bigint"))
    return counted.select("user_id", "period", "start", "scans", most.alias("most"), F.greatest(F.lit(0), most - F.col("scans")).cast("bigint").alias("left"), talks.alias("conversations"))


_DAYS = (["user_id", "day"], ["scans"])


def stream_usage(scans: DataFrame, path: str, checkpoint: str, delay: str = "1 day", buckets: int = versioned.BUCKETS):
    """Count scans by user and UTC day over a stream into a stored table; read it with ``usage_so_far``.

    Weeks and months differ in length and overlap, but both consist of whole days: a day is what the
    state holds, until the watermark has passed its end. Rows for days that are over are dropped, see
    ``late_rows``. Each micro-batch merges the new counts of the days that it changed.
    """
    day = F.window("scanned_at", "1 day")
    counted = scans.withWatermark("scanned_at", delay).groupBy("user_id", day.alias("w")).agg(F.count(F.lit(1)).alias("scans")).select("user_id", F.col("w.start").alias("day"), "scans")

    def merge(batch: DataFrame, batch_id: int) -> None:
        versioned.upsert_table(batch, path, *_DAYS, buckets)  # a day's count only grows

    return counted.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)


def usage_so_far(spark, path: str) -> DataFrame:
    """Rows as of ``usage_windows`` from what ``stream_usage`` has counted."""
    return _windows(versioned.read_upserted(spark, path, *_DAYS), F.col("day"))


def late_rows(query) -> int:
    """Rows that a finished or running query dropped behind its watermark, as its last progress reports tell.

    Rows of one user and day that a task has counted together are one row there.
    """
    return sum(state.numRowsDroppedByWatermark for progress in query.recentProgress for state in progress.stateOperators)


_OF_SUBSCRIPTIONS = "startswith(event_type, 'subscription.') and subscription_id is not null"


def resolve_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Subscription events with the ``user_id`` of their metadata (two spellings), else of their e-mail.

    ``events``: (event_id, event_type, subscription_id, metadata map, customer_email, status, event_ts);
    other event types, events without a subscription and unknown users are dropped.
    """
    named = F.coalesce(F.try_element_at("metadata", F.lit("userId")), F.try_element_at("metadata", F.lit("user_id")))
    rows = events.where(_OF_SUBSCRIPTIONS).withColumn("__named", named)
    by_id = users.select(F.col("user_id").alias("__id"))
    by_mail = users.groupBy(F.col("email").alias("customer_email")).agg(F.min("user_id").alias("__mail_user"))
    rows = rows.join(by_id, rows["__named"] == by_id["__id"], "left").join(by_mail, "customer_email", "left")
    return rows.withColumn("user_id", F.coalesce("__id", "__mail_user")).where("user_id is not null").drop("__named", "__id", "__mail_user")


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Existing and incoming rows as one table with the last row of each key."""
    return latest_by(existing.unionByName(incoming), keys, order)


def subscription_state(events: DataFrame) -> DataFrame:
    """(user_id, plan): pro if the user's last event is active or renewed, or another subscription is active.

    ``events`` holds (user_id, subscription_id, status, event_ts, event_id), as from ``resolve_users``.
    """
    subs = latest_by(events, ["user_id", "subscription_id"], ["event_ts", "event_id"])
    order = F.struct("event_ts", "event_id")
    last = subs.groupBy("user_id").agg(F.max_by(F.struct("subscription_id", "status"), order).alias("last"), F.count_if(F.col("status") == "active").alias("active"))
    now = F.col("last.status").isin("active", "renewed")
    return last.select("user_id", F.when(now | (F.col("active") > 0), "pro").otherwise("free").alias("plan"))


_SUBSCRIPTIONS = (["subscription_id"], ["event_ts", "event_id"])


def stream_subscriptions(events: DataFrame, users: Callable[[], DataFrame], path: str, checkpoint: str, patience_days: int = 30, buckets: int = versioned.BUCKETS):
    """Keep the latest row of each subscription in a stored table while raw events arrive; read it with ``subscriptions_so_far``.

    Each micro-batch reads ``users()`` (user_id, email) as it is then and resolves its events; those whose
    user isn't known yet wait, and are tried again with later micro-batches until they are
    ``patience_days`` older than the newest event. What is written follows the batch: changed
    subscriptions are added to their buckets, and only waiting events are written anew. Merging a
    batch twice changes nothing, so it may be repeated after a failure, and a restart with a fresh
    checkpoint goes on from the tables that are there.
    """
    spark = events.sparkSession
    done, waiting = f"{path}/subscriptions", f"{path}/waiting"

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        known = versioned.current(spark, waiting)
        known.buckets = known.buckets if known.number >= 0 else buckets
        tried = batch.where(_OF_SUBSCRIPTIONS)
        if known.number >= 0:
            tried = latest_by(tried.unionByName(versioned.read_version(spark, waiting)), ["event_id"], ["event_ts"])
        found = resolve_users(tried, users()).persist()
        versioned.upsert_table(found.drop("metadata", "customer_email", "event_type"), done, *_SUBSCRIPTIONS, buckets)
        newest = tried.agg(F.max("event_ts")).first()[0]
        late = F.lit(newest) - F.make_interval(days=F.lit(patience_days))
        left = tried.join(found.select("event_id"), "event_id", "left_anti").where(F.col("event_ts") >= late) if newest else tried
        layers = versioned.write_layer(left, waiting, ["event_id"], known.buckets)
        versioned.commit(spark, waiting, known, left.schema, {k: [f] for k, f in layers.items()})
        found.unpersist()
        batch.unpersist()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def subscriptions_so_far(spark, path: str) -> DataFrame:
    """The latest row of each subscription, from what ``stream_subscriptions`` wrote."""
    return versioned.read_upserted(spark, f"{path}/subscriptions", *_SUBSCRIPTIONS)
