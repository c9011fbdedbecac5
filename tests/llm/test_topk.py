import math
import random

import numpy as np
import pytest

from sitemetry.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def got(df):
    vectors = topk.quantised(df)
    return sorted(tuple(r) for r in topk.search(vectors, vectors.where("vec_id % 50 = 0")).collect())


@pytest.mark.parametrize("rows_in_block", [16_384, 70])
def test_against_brute_force(spark, monkeypatch, rows_in_block):
    monkeypatch.setattr(topk, "INDEX_ROWS", rows_in_block)
    monkeypatch.setattr(topk, "BLOCKS", 5)
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(12)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(130)]  # ties beyond k
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2050, [float("inf")] * 12), (2051, []), (2052, [0.5]), (None, [1.0]), (2100, [0.0] * 12), (2053, [900.0] * 12), (2053, [900.0] * 12)]
    assert got(table(spark, rows)) == brute(rows)


def test_few_and_none(spark):
    rows = [(50, [1.0, -1.0]), (100, [0.0, 2.0]), (3, [-1.0, 1.0])]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, rows[:1])) == []
    assert got(table(spark, rows).limit(0)) == []


def test_slices_add_up():
    r = np.random.default_rng(2)
    values, query = r.integers(-200, 200, (130, 9)).astype(np.int32), r.integers(-90, 90, 9)
    planes, _ = topk.slice_block(values)
    slices = topk.score_slices(planes, query)
    bits = np.unpackbits(slices.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(np.int64)
    total = (bits << np.arange(len(slices))[:, None]).sum(axis=0)
    exact = values.astype(np.int64) @ query
    assert len(set((total - exact).tolist())) == 1


def test_large_components_are_not_changed(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-4e6, 4e6) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e5, 1.0]), (101, [1e5, 0.0]), (102, [7e4, 0.0]), (150, [1.0 / 256]), (200, [0.0, 0.0, 0.0, 2.0**-8]), (201, [0.0, 0.0, 0.0, 2.0**54]), (202, [0.0, 0.0, 0.0, -(2.0**54)])]
    # query 150 reads the first component as it is: 25,600,000 for 100,000
    small = [x for x in rows if x[0] in (101, 102, 150, 200, 201, 202)]
    assert got(table(spark, small)) == brute(small)
    assert (150, 1, 101, 25_600_000) in got(table(spark, small))
    rows = [x for x in rows if x[0] < 150]
    assert got(table(spark, rows)) == brute(rows)
