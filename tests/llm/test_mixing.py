import hashlib
import math
from collections import Counter

from sitemetry.llm import mixing

from .helpers import documents


def unit(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / 16**13


def quantile(u, mean):
    n, p = 0, math.exp(-mean)
    total = p
    while u >= total:
        n += 1
        p *= mean / n
        total += p
    return n


def test_counts_equal_the_inverted_distribution(spark):
    rows = [(i, None if i % 7 == 0 else f"t{i}", "en", "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(600)] + [(1000 + i, "x", "en", "rare") for i in range(4)]
    df = documents(spark, rows)
    got = Counter(r["doc_id"] for r in mixing.replicate(df, {"big": 1, "": 2, "rare": 1}, 800).collect())
    sizes = Counter(s or "" for *_, s in rows)
    for doc, _, _, source in rows:
        source = source or ""
        weight = {"big": 0.25, "": 0.5, "rare": 0.25}.get(source)
        if weight is None:
            assert doc not in got
            continue
        rate = weight * 800 / sizes[source]
        draws = max(1, math.ceil(rate / 8))
        assert got[doc] == sum(quantile(unit("0", str(doc), str(k)), rate / draws) for k in range(1, draws + 1))


def test_shares_meet_the_weights_and_reruns_agree(spark):
    df = documents(spark, [(i, "x", "en", "a" if i % 10 else "b") for i in range(5000)])
    first = mixing.replicate(df, seed=3).select("doc_id", "mix_copy", "mix_order", "class_id", "mix_source").collect()
    assert sorted(first) == sorted(mixing.replicate(df.repartition(13), seed=3).select(*first[0].__fields__).collect())
    by = Counter(r["doc_id"] % 10 == 0 for r in first)
    assert abs(by[True] - 2500) < 300 and abs(by[False] - 2500) < 300
    assert len({(r["doc_id"], r["mix_copy"]) for r in first}) == len(first)


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = documents(spark, [(i, "x", "en", f"s{i % 5}") for i in range(300)])
    want = sorted(mixing.replicate(df).select("doc_id", "mix_copy").collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(mixing.replicate(df).select("doc_id", "mix_copy").collect()) == want


def test_empty_and_null(spark):
    df = documents(spark, [(None, None, None, None), (1, "a", None, None), (1, "a", None, None)])
    assert mixing.replicate(df.limit(0)).count() == 0
    got = Counter(r["doc_id"] for r in mixing.replicate(df, target_rows=30).collect())
    assert got[1] % 2 == 0 and got[1] > 0


def test_rows_of_null_id_are_drawn_by_their_text(spark):
    rows = [(None, f"text {i % 40}", "en", "a") for i in range(80)] + [(i, f"text {i}", "en", "a") for i in range(40)]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.replicate(documents(spark, rows), target_rows=240).collect())
    for doc, text, _, _ in rows:
        name = str(doc) if doc is not None else hashlib.md5(text.encode()).hexdigest()
        each = quantile(unit("0", name, "1"), 240 / 120)
        assert got[doc, text] == each * (2 if doc is None else 1)
    assert len({n for (doc, _), n in got.items() if doc is None}) > 2
