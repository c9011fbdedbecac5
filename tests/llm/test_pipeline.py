import hashlib
from collections import Counter

import corpus_pipeline
from sitemetry.llm import bpe
from sitemetry.llm.queries import QUERIES, tokenizer

from .helpers import words
from .test_mixing import quantile, unit
from .test_near_duplicates import brute as groups
from .test_near_duplicates import near
from .test_passages import brute as passages


def test_stages_against_brute_force(spark, tmp_path):
    shared = words(900, 60)
    rows = [(i, f"{words(i, 60)} {shared if i % 5 == 0 else ''} {words(200 + i, 40)}", f"s{i % 3}") for i in range(40)]
    rows += [(100, rows[1][1], "s0"), (101, near(rows[2][1], 1, 2), "s1"), (102, "12 34", "s0"), (103, None, "s0"), (104, "", None), (105, words(7, 5000), None)]
    table = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    lettered = [(d, t) for d, t, _ in rows if t and any(c.isalpha() for c in t)]
    one = {d for d, c, *_ in groups(lettered) if d == c}
    cut = {d: t for d, (t, _) in passages([(d, t) for d, t in lettered if d in one]).items()}
    source = {d: s or "" for d, _, s in rows}
    sizes = Counter(source[d] for d in cut)
    want = Counter()
    for d, t in cut.items():
        rate = 1 / len(sizes) * len(cut) / sizes[source[d]]
        n = quantile(unit("0", str(d), "1"), rate)
        if n:
            want[d, hashlib.sha256(t.encode()).hexdigest()] = n
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] and len(QUERIES) == 13


def test_each_stage_keeps_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    ids = corpus_pipeline.STAGES[-1][1](spark, docs.limit(5), "").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    codec = bpe.Codec(open(tokenizer()[0], "rb").read(), tokenizer()[1])
    assert all(codec.decode(r["ids"]).decode() == texts[r["doc_id"]] for r in ids)


def test_empty_tables_repeated_rows_and_clashing_names(spark, tmp_path):
    text = words(5, 80)
    rows = [(1, text, "en", "s", len(text), "a", "b"), (1, text, "en", "s", len(text), "a", "b"), (None, text, None, None, None, "a", "b"), (2, words(6, 90), "en", "s", 1, "a", "b"), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, "a", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, words_id string, parts string"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        got.collect()
    language, near, cut = (dict(corpus_pipeline.STAGES)[n] for n in ("language ID", "n-gram Jaccard join", "substring dedup"))
    assert Counter(r["doc_id"] for r in language(spark, docs, "").collect()) == Counter([1, 1, None, 2])
    assert Counter((r["doc_id"], r["text"] is None) for r in near(spark, docs, "").collect()) == Counter([(1, False), (2, False), (None, True), (3, False)])
    assert Counter((r["doc_id"], r["text"] == text) for r in cut(spark, docs, "").collect()) == Counter([(None, True), (1, False), (1, False), (2, False), (None, False), (3, False)])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
