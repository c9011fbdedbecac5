import random
from collections import Counter

import pytest

from sitemetry.llm import near_duplicates as nd

from .helpers import documents, words


def grams(text):
    w = nd.words_of(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    texts = {}
    for d, t in rows:
        key = tuple(nd.words_of(t or ""))
        if key:
            texts[key] = min(texts.get(key, d), d)
    keys = list(texts)
    sets = {k: grams(" ".join(k)) for k in keys}
    links, root = Counter(), {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), texts[k]), texts[k])
    out = []
    for d, t in rows:
        key = tuple(nd.words_of(t or ""))
        out.append((d, least[find(key)], texts[key], links[key]) if key else (d, d, d, 0))
    return sorted(out)


def near(text, seed, swaps):
    w = text.split()
    r = random.Random(seed)
    for i in r.sample(range(len(w)), swaps):
        w[i] = f"zz{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rows = [(i, words(i, 120)) for i in range(60)]
    base = words(999, 200)
    rows += [(100 + i, near(base, i, 1)) for i in range(90)] + [(300, base), (301, base), (302, base.upper()), (303, None), (304, ""), (305, "?!"), (306, "one two"), (307, "one two"), (308, "two one")]
    rows += [(400, words(7, 20_000)), (401, near(words(7, 20_000), 1, 200)), (500, near(words(3, 120), 2, 8))]
    return rows


@pytest.mark.parametrize("block", [384, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus()
    got = sorted(tuple(r) for r in nd.near_duplicates(documents(spark, rows), recall=0.9999).collect())
    assert got == brute(rows)


def test_one_stays(spark):
    rows = corpus()
    df = documents(spark, rows)
    kept = {r["doc_id"] for r in nd.keep_one_of_each_group(df).collect()}
    assert kept == {d for d, c, *_ in brute(rows) if d == c}
    assert nd.keep_one_of_each_group(df).columns == df.columns


def test_empty_and_null_ids(spark):
    df = documents(spark, [(None, "a b c d e f g"), (1, "x y z a b c d")])
    assert {tuple(r) for r in nd.near_duplicates(df).collect()} == {(None, None, None, 0), (1, 1, 1, 0)}
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_banding_meets_the_recall():
    bands, rows = nd.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= nd.RECALL and bands <= nd.MAX_BANDS


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "y")], "a string, b string")
    got = dict(tuple(r) for r in nd.components(edges).collect())
    assert got == {**{f"{i:03}": "000" for i in range(41)}, "x": "x", "y": "x"}


def test_rows_are_kept_by_their_own_text(spark):
    base, other = words(999, 200), words(5, 120)
    rows = [(1, base), (1, base), (1, other), (2, near(base, 1, 1)), (2, words(6, 120)), (1, near(base, 2, 1)), (9, "?!"), (9, "?!")]
    kept = Counter((r["doc_id"], r["text"]) for r in nd.keep_one_of_each_group(documents(spark, rows)).collect())
    stays = [t for (d, t) in kept if t in (base, near(base, 2, 1))]
    assert len(stays) == 1 and kept == Counter([(1, stays[0]), (1, other), (2, words(6, 120)), (9, "?!"), (9, "?!")])
    assert nd.keep_one_of_each_group(documents(spark, [(1, base)] * 3)).count() == 1


def test_null_ids_are_linked_and_one_stays(spark):
    base = words(999, 200)
    alone = documents(spark, [(None, base), (None, near(base, 1, 1)), (None, words(6, 120))])
    assert sorted(r["links"] for r in nd.near_duplicates(alone).collect()) == [0, 1, 1]
    assert nd.keep_one_of_each_group(alone).count() == 2
    mixed = documents(spark, [(None, base), (3, near(base, 1, 1))])
    assert [r["doc_id"] for r in nd.keep_one_of_each_group(mixed).collect()] == [3]
