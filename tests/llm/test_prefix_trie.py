import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from sitemetry.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, words string, k1 long"
SF = Path("/root/testdata/sf0.001")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def brute(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    paths = own
    if rebuild:
        paths = {}
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 4, c - int(np.fmod(c, 20))
            paths[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, ids in members.items():
        n_leaves = saved = 0
        stack = [p]
        while stack:
            q = stack.pop()
            n_leaves += not kids[q]
            if q:
                saved += (len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1]))
            stack += kids[q]
        ends = ",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), n_leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: (r[0], r[1]))


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["", "a b", "c d e", "é", "one two three", None]
    rows = []
    for c in range(-25, n):
        for t in range(r.randrange(0, 7)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(texts)))
    # a hot start, a hot conversation, and a long chain that many share
    for c in range(2000, 2120):
        rows += [(c, 0, "system", "hot start"), (c, 1, "user", "same" if c % 3 else f"own {c}")]
    for c in range(3000, 3090):
        rows += [(c, t, "user", f"chain {t}") for t in range(30)] + ([(c, 30, "user", f"{c}")] if c % 2 else [])
    return rows


@pytest.mark.parametrize(("hot", "block"), [(64, 8192), (2, 7)])
def test_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(prefix_trie, "HOT_CONVERSATIONS", hot)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", block)
    rows = conversations(1, 150)
    # repeated rows, a null turn, ties, a conversation of nulls, a null id, a very long text
    rows += [(500, 0, "user", "again"), (500, 0, "user", "again"), (501, None, "user", "first"), (501, 0, "user", "second"), (502, 3, "b", "x"), (502, 3, "a", "y"), (502, 3, "a", "x"), (503, None, None, None), (None, 0, "user", "no id"), (504, 0, "user", "w " * 300_000)]
    df = table(spark, rows)
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(df)))) == brute(rows)
    assert got(prefix_trie.prefix_trie(prefix_trie.sequences(prefix_trie.turn_rows(df)))) == brute(rows, rebuild=False)


def test_few_and_none(spark):
    df = table(spark, [(7, 0, "user", "x")])
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(df)))) == brute([(7, 0, "user", "x")])
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(df.limit(0))))) == []
    only = [(1, 0, "user", "x")]  # takes its first turns from conversation 0, which there is not
    assert zlib.crc32(b"1") % 4 == 3
    assert got(prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(table(spark, only))))) == brute(only) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_prefix_trie(spark, str(SF))) == brute(rows)


def test_arrays_hold_every_family():
    r = np.random.default_rng(4)
    trie = prefix_trie.DoubleArray(5_000)
    level, all_pairs = np.zeros(1, np.int64), {}
    for _ in range(4):
        pairs = np.unique(np.concatenate([int(n) * 5_000 + r.choice(5_000, r.integers(0, 40), replace=False) for n in level]))
        parents, turns = pairs // 5_000, pairs % 5_000
        trie.add_level(parents, turns)
        to = trie.step(parents, turns)
        assert (to > 0).all() and len(set(to.tolist())) == len(to) and not set(to.tolist()) & set(all_pairs.values())
        all_pairs |= {(int(p), int(t)): int(x) for p, t, x in zip(parents, turns, to, strict=True)}
        level = to[:60]
    probe = r.integers(0, trie.end, 3_000), r.integers(0, 6_000, 3_000)
    assert trie.step(*probe).tolist() == [all_pairs.get((int(a), int(b)), -1) for a, b in zip(*probe, strict=True)]
