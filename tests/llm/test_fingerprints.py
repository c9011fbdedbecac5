import hashlib
import re
from collections import Counter

import pytest
import xxhash

from sitemetry.llm import fingerprints as fp

from .helpers import documents, words

MASK = (1 << 64) - 1


def over(parts):
    """xxHash64 chained over strings and longs (8 bytes) or ints (4 bytes), as the engine defines it."""
    seed = 42
    for p in parts:
        if p is not None:
            seed = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.encode(), seed)
    return seed


def long(x):
    return (x & MASK).to_bytes(8, "little")


def brute(text):
    w = re.findall(rf"[{fp.UNSPACED}]|[^ \t\n\r\f{fp.UNSPACED}]+", (text or "").lower())
    kmers = [over(w[i : i + fp.K]) for i in range(len(w) - fp.K + 1)] if len(w) >= fp.K else ([over(w)] if w else [])
    seen, values = Counter(), []
    for place, k in enumerate(kmers):
        mixed = over([long(k), seen[k].to_bytes(4, "little")])
        seen[k] += 1
        values.append((mixed & ~fp._PLACES) | (place & fp._PLACES))
    out = ["-"] * (1 << fp.SLOT_BITS)
    for slot in range(1 << fp.SLOT_BITS):
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        chosen = sorted((v for v in values if v >> (64 - fp.SLOT_BITS) == slot), key=signed)[: fp.PER_SLOT]
        if chosen:
            chosen.sort(key=lambda v: (v & fp._PLACES, v >> fp.PLACE_BITS))
            out[slot] = f"{over([long(v >> fp.PLACE_BITS) for v in chosen]) & 0xFFFFFFFF:08x}"
    return ".".join(out)


def alike(a, b):
    pairs = [(x, y) for x, y in zip(a.split("."), b.split("."), strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize(("piece_rows", "ranges"), [(1000, 20_000), (4, 20_000), (4, 3)])
def test_against_brute_force(spark, monkeypatch, piece_rows, ranges):
    monkeypatch.setattr(fp, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(fp, "MAX_RANGES", ranges)
    rows = [(3 * i, words(i, 30 + 5 * i)) for i in range(25)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "one two"), (104, "la la la " * 60), (105, "x" * 3000), (106, words(9, 20_000)), (107, words(3, 45)), (108, words(3, 45)), (-5, "Ünïcode 😀 text " * 9), (10**18, "天地人" * 30)]
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(documents(spark, rows)).collect()}
    ordered = sorted((d, t or "") for d, t in rows)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (brute(text), brute(edited))
        assert r["near_edited"] == pytest.approx(alike(brute(text), brute(edited))) and r["near_next"] == pytest.approx(alike(brute(text), brute(after)))
    assert got[107]["fingerprint"] == got[108]["fingerprint"] and got[107]["near_next"] == 1.0


def test_likeness_falls_with_order_and_edits():
    a = words(1, 400)
    w = a.split()
    moved = " ".join(w[200:] + w[:200])
    assert alike(brute(a), brute(moved)) < 1.0
    import random

    falls = []
    for share in (0.0, 0.02, 0.1, 0.3, 0.7):
        found = []
        for seed in range(12):
            r = random.Random(seed)
            found.append(alike(brute(a), brute(" ".join(words(1000 + i, 1) if r.random() < share else x for i, x in enumerate(w)))))
        falls.append(sum(found) / len(found))
    assert falls[0] == 1.0 and all(x > y for x, y in zip(falls, falls[1:], strict=False)) and falls[-1] < 0.1


@pytest.mark.parametrize("ranges", [20_000, 3])
def test_many_rows_of_one_id(spark, monkeypatch, ranges):
    """Equal and null ids are spread over pieces by the hash of their text."""
    monkeypatch.setattr(fp, "PIECE_ROWS", 4)
    monkeypatch.setattr(fp, "MAX_RANGES", ranges)
    rows = [(7, words(i, 20)) for i in range(40)] + [(None, words(100 + i, 20)) for i in range(30)] + [(i, words(200 + i, 20)) for i in range(5, 12)] + [(7, words(3, 20))] * 2
    signed = lambda t: (lambda v: v - (1 << 64) if v >> 63 else v)(xxhash.xxh64_intdigest(t.encode(), 42))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))
    want = Counter()
    for i, (doc, text) in enumerate(ordered):
        cut = len(text) // 4
        want[doc, hashlib.sha256((text[: len(text) - cut] + ordered[(i + 1) % len(ordered)][1][:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in fp.fingerprint_documents(documents(spark, rows)).collect()) == want
    if ranges == 3:  # too few ranges to tell the ids apart
        return
    keyed = documents(spark, rows).selectExpr("coalesce(doc_id, -9223372036854775808) as k", "text")
    sizes = fp._pieces(keyed, "k", "text", fp._range_starts(keyed, "k")).groupBy("__r", "__piece").count().collect()
    assert max(r["count"] for r in sizes) <= 16


def test_ties_null_ids_and_empty(spark):
    df = documents(spark, [(None, "a b c d"), (1, "b b b b"), (1, "a a a a"), (1, "a a a a")])
    got = fp.fingerprint_documents(df).collect()
    assert len(got) == 4 and sum(r["doc_id"] is None for r in got) == 1
    assert fp.fingerprint_documents(df.limit(0)).count() == 0
    assert fp.fingerprint_documents(df.limit(1)).first()["near_next"] == 1.0
