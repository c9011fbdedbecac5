import math
import random
from pathlib import Path

import numpy as np
import pytest

from sitemetry.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int, h1 long"
SF = Path("/root/testdata/sf0.1")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i, tuple(float(np.float32(x)) for x in v)] = None  # a repeated row counts once
    asked = {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = []
        for i, w in good:
            if i != q:
                s = 0.0
                for a, b in zip(v, w):
                    s += b * a
                scored.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df, k=20):
    vectors = neighbours.usable(df)
    return sorted(tuple(r) for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), k).collect())


def recall(found, true):
    best = {(q, i) for q, _, i, _ in true}
    return len(best & {(q, i) for q, _, i, _ in found}) / len(best)


@pytest.mark.parametrize("least_points", [2_048, 60])
def test_small_tables_are_searched_whole(spark, monkeypatch, least_points):
    monkeypatch.setattr(neighbours, "LEAST_POINTS", least_points)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows += [(1000 + i, rows[40][1]) for i in range(70)]  # copies beyond k
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (2080, []), (2100, [0.0] * 6), (None, [1.0] * 6), (2120, [0.5]), (2121, [3e4] * 6), (2121, [3e4] * 6), (2140, [1e-20] * 6), (2140, [2.0] * 6)]
    assert got(table(spark, rows)) == brute(rows)


def test_few_and_none(spark):
    rows = [(20, [1.0, -1.0]), (40, [0.0, 2.0]), (3, [-1.0, 1.0])]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, rows[:1])) == []
    assert got(table(spark, rows).limit(0)) == []


def test_a_hot_vector_keeps_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(400)] + [(400 + i, [math.cos(i), math.sin(i)]) for i in range(40)] + [(7, [1.0, 0.0])] * 50
    assert got(table(spark, rows)) == brute(rows)


def test_recall_against_brute_force_on_all_given_vectors(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    found = [tuple(r) for r in queries.op13_nearest_neighbours(spark, str(SF)).collect()]
    values = {i: np.array(v, np.float64) for i, v in rows}
    ids = np.array(sorted(values))
    scores = np.stack([values[i] for i in ids]) @ np.stack([values[i] for i in ids[ids % 20 == 0]]).T
    true = []
    for c, q in enumerate(ids[ids % 20 == 0]):
        order = [i for i in np.lexsort((ids, -scores[:, c])) if ids[i] != q][:20]
        true += [(int(q), k + 1, int(ids[i]), 0) for k, i in enumerate(order)]
    assert len(found) == len(true) and recall(found, true) >= 0.97
    assert all(abs(s - values[q] @ values[i]) < 1e-12 for q, _, i, s in found)
    for q in {f[0] for f in found}:
        own = sorted((f for f in found if f[0] == q), key=lambda f: f[1])
        assert [f[1] for f in own] == list(range(1, 21)) and own == sorted(own, key=lambda f: (-f[3], f[2])) and q not in [f[2] for f in own]


@pytest.mark.parametrize("norms", ["even", "uneven"])
def test_recall_of_a_shard(norms):
    r = np.random.default_rng(2)
    values = r.normal(size=(5_000, 24)) * (r.lognormal(0, 1, (5_000, 1)) if norms == "uneven" else 1)
    shard = neighbours.Shard(np.arange(5_000), values)
    exact = values[:200] @ values.T
    exact[np.arange(200), np.arange(200)] = -np.inf
    true = np.argsort(-exact, axis=1)[:, :20]
    hits = sum(len(set(t.tolist()) & set(i.tolist())) for (_, i, _), t in zip(shard.top(np.arange(200), values[:200], 20), true, strict=True))
    assert hits >= 0.95 * 200 * 20


def test_robust_pruning_keeps_diverse_edges():
    points = neighbours.lifted(np.array([[1.0, 0, 0], [0.99, 0.14, 0], [0.98, 0.2, 0], [0.9, 0, 0.43], [0, 0, 1]]))
    near = ((points[None] - points[:, None]) ** 2).sum(axis=2)
    (kept,) = neighbours.robust_prune(points, np.array([[1, 2, 3, 4]]), near[:1, 1:].copy())
    assert kept[kept >= 0].tolist() == [1, 3]  # 2 is near 1, 4 is near 3
