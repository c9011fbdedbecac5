import zlib
from collections import Counter

import numpy as np

from sitemetry.llm import language_id as li

from .helpers import documents, words


def test_gradients_match_differences():
    net = li.Network.fresh(["a", "b"], hidden=3, seed=1)
    for part in net.parts():
        part *= 0.3  # away from the clipping corners
    net.close_pad()
    r = np.random.default_rng(0)
    windows = r.integers(97, 101, (6, 4)).astype(np.uint16)
    windows[4:, 1] = li.PAD
    labels = np.array([0, 1, 1, 0])

    def loss():
        p = net.probabilities(windows)[:, labels, np.arange(4)]
        real = windows != li.PAD
        return float(-(np.log(p) * real).sum() / real.sum())

    for part, grad in zip(net.parts(), li._gradients(net, windows, labels), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = part[at]
        part[at] = old + 1e-2
        up = loss()
        part[at] = old - 1e-2
        down = loss()
        part[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 0.03 * abs(grad[at]) + 1e-3


def test_long_text_is_read_whole_and_batching_changes_nothing():
    net = li.Network.fresh(["a", "b"], seed=2)
    texts = [b"x", b"", b"abc" * 40_000, bytes(range(32, 127)) * 7]
    together = net.document_probabilities(texts)
    for i, t in enumerate(texts):
        assert np.allclose(net.document_probabilities([t])[0], together[i], atol=1e-5)
    changed = net.document_probabilities([texts[2][:-3] + b"zzz"])[0]
    assert not np.allclose(changed, together[2], atol=1e-9)
    assert len(net.label_positions("héllo")) == 6


def test_network_against_plain_loops():
    """Probabilities of every byte and of whole documents, cell by cell without arrays."""
    net = li.Network.fresh(["a", "b", "c"], hidden=3, seed=9)
    clip = lambda x: min(1.0, max(-1.0, x))

    def states(codes, d):
        h, out = [0.0] * 3, []
        for code in codes:
            fed = [float(x) for x in net.table[d][code]]
            gate = [(clip(fed[j] + sum(float(net.gates[d][j][i]) * h[i] for i in range(3))) + 1) / 2 for j in range(6)]
            cand = [clip(fed[6 + j] + sum(float(net.state[d][j][i]) * gate[3 + i] * h[i] for i in range(3))) for j in range(3)]
            h = [h[j] + gate[j] * (cand[j] - h[j]) for j in range(3)]
            out.append(h)
        return out

    for text in ("a", "héllo wörld", "the quick brown fox " * 9, "z" * li.WINDOW, "é" * 97):
        total, labels, data = [0.0] * 3, [], text.encode()
        for at in range(0, len(data), li.WINDOW):
            part = data[at : at + li.WINDOW]
            forward, backward = states(part, 0), states(part[::-1], 1)[::-1]
            for f, b in zip(forward, backward, strict=True):
                e = [np.exp(float(net.bias[k][0]) + sum(float(net.out[k][i]) * x for i, x in enumerate(f + b))) for k in range(3)]
                p = [x / sum(e) for x in e]
                labels.append(net.languages[int(np.argmax(p))])
                total = [t + x for t, x in zip(total, p, strict=True)]
        assert np.allclose(net.document_probabilities([data])[0], np.array(total) / len(data), atol=1e-4)
        assert sum(x == y for x, y in zip(net.label_positions(text), labels, strict=True)) >= 0.99 * len(labels)


def test_pipeline_threshold_on_held_out_documents(spark):
    """Documents with a majority are right almost always, few others are dropped, and the network decides, not the letters."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    kept = [r for r in got if r["score"] > li.MAJORITY]
    assert len(kept) > 0.995 * len(got) and sum(r["lang_pred"] == r["lang"] for r in kept) > 0.99 * len(kept)
    dropped = docs.join(li.keep_identified(docs).select("doc_id"), "doc_id", "left_anti")
    assert 0 < dropped.where("text rlike '\\\\p{L}'").count() < 0.005 * docs.count()


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert 0.2 < len(out) / len(got) < 0.45
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_defined_cases(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "en"), (103, "the dog", None), (103, "the dog", None), (None, "die katze", None), (104, "und die katze " * 20_000, None)]
    df = documents(spark, rows)
    got = {}
    for r in li.identify(df).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"], r["held_out"]))
    assert [got[i][0][:2] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert [x[0] for x in got[103]] == ["en", "en"] and got[None][0][0] == "de" and not got[None][0][2] and got[104][0][0] == "de"
    kept = li.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert li.identify(df.limit(0)).count() == 0
    unlabelled = documents(spark, [(1, "text", None)])
    assert li.identify(unlabelled).first()["lang_pred"] == "und"


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(None, "12 34", "en"), (None, words(1, 30), "en"), (5, "?!", "en"), (5, words(2, 30), "en"), (5, None, None), (6, words(3, 30), "en"), (7, words(4, 30), "en")]
    kept = li.keep_identified(documents(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter((d, t) for d, t, _ in rows if t and t[0].isalpha())


def test_nothing_learned_drops_letterless_texts_only(spark):
    rows = [(i, words(i, 20)) for i in range(6)] + [(10, "12 34"), (11, None), (12, "")]
    assert sorted(r["doc_id"] for r in li.keep_identified(documents(spark, rows)).collect()) == list(range(6))
