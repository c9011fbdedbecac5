import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitemetry.llm import divergence

from .helpers import documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10):
    rows = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source in rows]
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in rows:
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    out = []
    for lang in {k[0] for k in counts}:
        v, terms = len(kept[lang]), kept[lang]
        sources = [s for g, s in counts if g == lang]
        whole = sum((counts[lang, s] for s in sources), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in terms) + 2 * v) for t in terms}  # noqa: B023, E731
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            told = sorted((-gap(p[s][t], q[t]), t.encode()) for t in terms if counts[lang, s][t] and p[s][t] > q[t])[:10]
            for part, found in (("pair", pairs), ("term", told)):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


def got(spark, rows):
    return sorted(tuple(r) for r in divergence.divergence(documents(spark, rows)).collect())


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgEFG") for _ in range(r.randrange(1, 4))) for _ in range(300)] + ["naïve", "ÉTÉ", "été", "日本語", "x\u0080y", "word﻿"]
    seps = [" ", ", ", "\n", "-", "9", "_", "\x7f", "@"]
    return [(i, "".join(r.choice(words[: 20 + 20 * (i % 15)]) + r.choice(seps) for _ in range(r.randrange(0, 60))), r.choice(["en", "de", "", None]), r.choice(["a", "b", "ü", "Z", "", None])) for i in range(n)]


@pytest.mark.parametrize(("shard", "round_bytes", "most"), [(1_024, 64_000_000, 4_000_000), (16, 3_000, 10)])
def test_against_brute_force(spark, monkeypatch, shard, round_bytes, most):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(divergence, "MOST_SLOTS", most)
    rows = corpus(1, 400)
    rows += [(i, "rare words here", "fr", "abc"[i % 3]) for i in range(9)]  # a language without kept terms
    rows += [(5, None, "en", "nothing"), (5, "9 9", "en", "digits"), (5, "", "lonely", "s"), (None, "abc " * 100_000, "en", "long")]
    rows += rows[:40]  # repeated rows count
    assert got(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert got(spark, []) == []
    rows = [(i, "same text", "en", "s") for i in range(10)]
    assert got(spark, rows) == brute(rows) == []  # one source, which is its language
    rows += [(11, "other", "en", "t")]
    assert got(spark, rows) == brute(rows)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "MOST_BYTES", 7)
    text = "Abc defghijklmnopqrstuvwxyzé  üü,x " * 5 + "endlessendlessendless"
    assert [t.decode() for part in divergence.terms_of(text.encode()) for t in part] == TERM.findall(text.translate(LOWER))


def test_perfect_hash_is_minimal_and_verified():
    terms = [f"term{i}".encode() for i in range(2_000)]
    for n in (1, 2, 3, 50, 2_000):
        seed, shifts, placed = divergence.perfect_hash(terms[:n])
        assert sorted(placed) == sorted(terms[:n])
        hashes = np.array([xxhash.xxh64_intdigest(t, seed) for t in placed], np.uint64)
        home = (hashes >> np.uint64(32)).astype(np.int64) % len(shifts)
        assert divergence._slots(hashes, shifts[home], np.array(n)).tolist() == list(range(n))


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(2_000):
        total = r.randrange(2, 10 ** r.randrange(1, 16))
        count = r.randrange(-1, total - 2) if total > 2 else 0
        assert int(divergence.scaled_shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 2) // total


def test_shards_are_dealt_as_spark_deals_them(spark):
    terms = ["a", "é", "日本語" * 30, "x" * 31, "y" * 32, "z" * 100]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(np.uint64(xxhash.xxh64_intdigest(r["t"].encode(), 42)).astype(np.int64) == r["h"] for r in rows)
