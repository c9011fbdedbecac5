import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from sitemetry.sources import tables, versioned
from sitemetry.streaming import jobs


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# ---- stored tables


def crawls(spark, *rows):
    return spark.createDataFrame(list(rows), "crawl_run_id string, n int")


def test_results_are_replaced_once(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_results(crawls(spark, ("a", 1), ("b", 1), ("b", 2)), path, 2)
    for _ in range(2):
        tables.replace_results(crawls(spark, ("b", 5)), path, 2)
    assert rows_of(tables.read_table(spark, path).select("crawl_run_id", "n")) == [("a", 1), ("b", 5)]
    assert rows_of(tables.read_table(spark, path, crawls=["b", "none"])) == [("b", 5)]
    tables.replace_results(crawls(spark), path, 2)
    assert rows_of(tables.read_table(spark, path)) == [("a", 1), ("b", 5)]


def test_readers_never_see_half_of_a_change(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.replace_results(crawls(spark, *[(f"c{i}", 1) for i in range(20)]), path, 4)
    reading = tables.read_table(spark, path)

    def stopped(*_):
        raise RuntimeError("stopped between write and commit")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(versioned, "commit", stopped)
        tables.replace_results(crawls(spark, *[(f"c{i}", 2) for i in range(0, 20, 2)]), path, 4)
    assert rows_of(tables.read_table(spark, path)) == [(f"c{i}", 1) for i in sorted(range(20), key=lambda i: f"c{i}")]
    tables.replace_results(crawls(spark, *[(f"c{i}", 2) for i in range(0, 20, 2)]), path, 4)
    assert {tuple(r) for r in tables.read_table(spark, path).collect()} == {(f"c{i}", 1 + (i % 2 == 0)) for i in range(20)}
    assert reading.count() == 20  # the version before is still there for those who read it


def test_versions_are_committed_once_and_old_data_goes(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(5):
        tables.replace_results(crawls(spark, ("a", n), ("b", n)), path, 2)
    assert versioned._version_numbers(spark, path) == [3, 4]
    named = {f for n in (3, 4) for v in versioned._manifest(spark, path, n).layers.values() for f in v}
    assert {str(p.relative_to(path)) for p in Path(path).glob("data/*/bucket=*")} == named
    base = versioned._manifest(spark, path, 3)
    with pytest.raises(Exception, match="[Ee]xist"):
        versioned.commit(spark, path, base, tables.read_table(spark, path).schema, base.layers)


def stored_bytes(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_upserts_write_what_changes(spark, tmp_path):
    path, by = str(tmp_path / "t"), (["k"], ["at"])
    make = lambda rows: spark.createDataFrame(rows, "k long, at long, v string")
    versioned.upsert_table(make([(k, 0, f"first {k}" * 20) for k in range(20_000)]), path, *by, buckets=4)
    whole = stored_bytes(path)
    want = {k: (0, f"first {k}" * 20) for k in range(20_000)}
    for n in range(1, 12):  # beyond LAYERS, so buckets are merged too
        change = [(k, n, f"change {n}") for k in range(n, 40)] + [(k, -1, "too old") for k in range(50, 60)]
        before = stored_bytes(path)
        versioned.upsert_table(make(change * 2), path, *by)
        if n < versioned.LAYERS:
            assert stored_bytes(path) - before < whole / 20
        want |= {k: (at, v) for k, at, v in change if at > 0}
        if n in (1, 7, 8, 11):
            assert {r["k"]: (r["at"], r["v"]) for r in versioned.read_upserted(spark, path, *by).collect()} == want
    versioned.upsert_table(make([]), path, *by)
    assert versioned.read_upserted(spark, path, *by).count() == 20_000


# ---- counters of crawls

FETCHES = "crawl_run_id string, url string, status_code long, content_type string, internal_links array<string>, fetched_at timestamp, crawled long"


def test_counters_of_a_stream_are_those_of_its_batch(spark, tmp_path):
    start, page = datetime(2024, 1, 1), "text/html"
    hour = lambda n: start + timedelta(hours=n)
    parts = [
        [("c", None, None, None, ["u", "s"], start, 0), ("c", "u", 200, page, ["v", "w", "v"], hour(2), 0), ("c", "v", 404, page, ["lost"], start, 0), ("d", "u", None, None, ["lost"], start, 0), (None, "u", 200, page, [], start, 0)],
        [("c", "u", 500, page, ["lost"], hour(1), 0), ("c", "w", 200, "text/plain", ["lost"], hour(2), 0), ("c", "u", 200, page, ["x"], hour(3), 0)],  # the first fetch of u comes late: no longer fine
        [("d", "u", 200, page, None, hour(48), 0), ("d", "x", 200, page, ["u", "x", "y"], hour(48), 0), ("c", "v", 200, page, ["z"], hour(-1), 0)],
    ]
    every, counts = [], []
    for k, part in enumerate(parts):
        every += part
        spark.createDataFrame(part, FETCHES).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in"))  # a restart each time
        jobs.stream_crawl_counters(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        counts.append(rows_of(jobs.counters_so_far(spark.read.parquet(str(tmp_path / "out")))))
        assert counts[k] == rows_of(jobs.crawl_counters(spark.createDataFrame(every, FETCHES)))
    assert counts == [[("c", 2, 1, 4), ("d", 1, 0, 0)], [("c", 3, 1, 5), ("d", 1, 0, 0)], [("c", 3, 2, 6), ("d", 2, 1, 3)]]


def test_counters_keep_urls_in_buckets(spark, tmp_path):
    start, page = datetime(2024, 1, 1), "text/html"
    parts = [  # what the first two leave is over when the last one comes
        [("c", f"u{i}", 200 if i % 2 else 404, page, [f"u{i + 1}", "home"], start, 0) for i in range(500)] + [(f"r{i}", "u", 200, page, None, start, 0) for i in range(100)],
        [("c", f"u{i}", 500, page, ["home"], start + timedelta(days=4), 0) for i in range(400, 600)] + [("c", "u1", 404, page, [], start - timedelta(hours=1), 0)],
        [("c", f"new{i}", 200, page, [], start + timedelta(days=30), 0) for i in range(500)],
        [("c", f"last{i}", 200, page, [], start + timedelta(days=31), 0) for i in range(500)],
    ]
    every, remembered = [], []
    for part in parts:
        every += part
        spark.createDataFrame(part, FETCHES).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.stream_crawl_counters(spark.readStream.schema(FETCHES).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), buckets=8).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert rows_of(jobs.counters_so_far(spark.read.parquet(str(tmp_path / "out")))) == rows_of(jobs.crawl_counters(spark.createDataFrame(every, FETCHES)))
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
        states = spark.read.format("statestore").load(str(tmp_path / "state")).select("value.*").collect()
        remembered.append(sum(len(json.loads(text)) for r in states for text in [r["groupState"]["urls"]]))
    assert remembered == [602, 701, 1201, 1000]


# ---- usage


def test_usage_of_a_stream(spark, tmp_path):
    day = lambda *d: datetime(2024, *d)
    parts = [[("u", day(1, 30, 23)), ("u", day(1, 31)), ("v", day(1, 28)), (None, day(1, 31))], [("u", day(2, 1)), ("u", day(2, 4, 23)), ("u", day(2, 5))], [("u", day(1, 2)), ("v", day(1, 3)), ("u", day(2, 29))]]
    every, late = [], 0
    for k, part in enumerate(parts):
        every += [x for x in part if k < 2 or x[1] > day(2, 1)]  # what comes a month late is dropped
        spark.createDataFrame(part, "user_id string, scanned_at timestamp").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id string, scanned_at timestamp").parquet(str(tmp_path / "in"))
        query = jobs.stream_usage(stream, str(tmp_path / "days"), str(tmp_path / "state"), buckets=2).trigger(availableNow=True).start()
        query.awaitTermination(120)
        late += jobs.late_rows(query)
        assert rows_of(jobs.usage_so_far(spark, str(tmp_path / "days")).na.fill("", ["user_id"]).na.fill(0)) == rows_of(jobs.usage_windows(spark.createDataFrame(every, "user_id string, scanned_at timestamp")).na.fill("", ["user_id"]).na.fill(0))
    assert late == 2
    month = jobs.usage_so_far(spark, str(tmp_path / "days")).where("user_id = 'u' and period = 'month'").orderBy("start").collect()
    assert [(r["start"].month, r["scans"], r["conversations"]) for r in month] == [(1, 2, 20), (2, 4, 40)]


# ---- subscriptions

EVENTS = "event_id long, event_type string, subscription_id string, metadata map<string,string>, customer_email string, status string, event_ts timestamp"


def test_users_of_subscription_events(spark):
    users = spark.createDataFrame([("u1", "a@x.org"), ("u2", "b@x.org")], "user_id string, email string")
    rows = [(1, "subscription.active", "s1", {"userId": "u1"}, "b@x.org"), (2, "subscription.active", "s2", {"user_id": "u2"}, None), (3, "subscription.active", "s3", {"userId": "gone"}, "b@x.org"), (4, "payment.ok", "s4", {}, "a@x.org"), (5, "subscription.active", "s5", {}, "no@x.org")]
    events = spark.createDataFrame([(*r, "active", None) for r in rows], EVENTS)
    assert {r["event_id"]: r["user_id"] for r in jobs.resolve_users(events, users).collect()} == {1: "u1", 2: "u2", 3: "u2"}


def test_subscriptions_of_a_stream(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    event = lambda i, sub, meta, mail, status, d: (i, f"subscription.{status}", sub, meta, mail, status, at(d))
    parts = [
        [event(1, "s1", {"userId": "u1"}, None, "active", 1), event(2, "s2", None, "b@x.org", "active", 1), event(3, "s3", {"user_id": "late"}, None, "active", 2), (4, "payment.done", "s1", {"userId": "u1"}, None, "cancelled", at(9))],
        [event(5, "s1", {"userId": "gone"}, "a@x.org", "cancelled", 3), event(6, "s3", {"user_id": "late"}, None, "on_hold", 4)],
        [event(7, "s2", None, "b@x.org", "renewed", 5), event(8, "s9", {"userId": "nobody"}, None, "active", 5), event(1, "s1", {"userId": "u1"}, None, "active", 1)],
        [event(9, "s2", None, "b@x.org", "active", 5)],
    ]
    users = spark.createDataFrame([("u1", "a@x.org"), ("u2", "b@x.org")], "user_id string, email string")
    more = users.union(spark.createDataFrame([("late", "l@x.org")], "user_id string, email string"))
    path, plans = str(tmp_path / "subs"), []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
        known = users if k < 2 else more
        state = tmp_path / ("fresh" if k == 3 else "state")  # one restart without its checkpoint merges everything again
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        jobs.stream_subscriptions(stream, lambda known=known: known, path, str(state), buckets=2).trigger(availableNow=True).start().awaitTermination(120)
        plans.append({r["user_id"]: r["plan"] for r in jobs.subscription_state(jobs.subscriptions_so_far(spark, path)).collect()})
    assert plans == [{"u1": "pro", "u2": "pro"}, {"u1": "free", "u2": "pro"}, {"u1": "free", "u2": "pro", "late": "free"}, {"u1": "free", "u2": "pro", "late": "free"}]
    batch = jobs.resolve_users(spark.createDataFrame([e for p in parts for e in p], EVENTS), more)
    assert plans[-1] == {r["user_id"]: r["plan"] for r in jobs.subscription_state(batch).collect()}
    assert [r["event_id"] for r in versioned.read_version(spark, f"{path}/waiting").collect()] == [8]


def test_events_wait_for_their_user_no_longer_than_told(spark, tmp_path):
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    users = spark.createDataFrame([("u", "u@x.org")], "user_id string, email string")
    for k, d in enumerate((0, 20, 45)):
        spark.createDataFrame([(k, "subscription.active", f"s{k}", {"userId": "nobody"}, None, "active", at(d))], EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        jobs.stream_subscriptions(stream, lambda: users, str(tmp_path / "subs"), str(tmp_path / "state"), buckets=2).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["event_id"] for r in versioned.read_version(spark, str(tmp_path / "subs/waiting")).collect()) == [1, 2]
