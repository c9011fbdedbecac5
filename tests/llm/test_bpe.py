import base64
import hashlib
import random

import public_tokenizers
import regex
import tiktoken

from sitemetry.llm import bpe
from sitemetry.llm.queries import tokenizer

from .helpers import documents, words

PATH, PATTERN = tokenizer()
RAW = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_equal_tiktoken():
    codec, r = bpe.Codec(RAW, PATTERN), random.Random(3)
    texts = ["", "a", " ", "I've  it's\n\n x", "straße école ñandú", "日本語のテキスト 123", "ab" * 20_000, "é" * 3000, "x" * 5000 + " " * 50, words(1, 400)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x250), r.randrange(0x250, 0x3000), 32, 10])) for _ in range(80)) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == TIKTOKEN.encode_ordinary(text)
        assert codec.decode(ids).decode() == text


def test_latin_matcher_cuts_like_the_general_one():
    find, general, r = bpe.pattern_finder(PATTERN), regex.compile(PATTERN), random.Random(4)
    for _ in range(2000):
        text = "".join(chr(r.choice([r.randrange(0x250), 32, 10, 39, 115, 0x85, 0x1C])) for _ in range(40))
        assert find(text) == general.findall(text)


def test_encode_rows(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, words(5, 30_000))]
    df = documents(spark, rows)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) for r in bpe.encode(df, PATH, PATTERN).collect())
    want = []
    for doc, text in rows:
        ids = TIKTOKEN.encode_ordinary(text or "")
        want.append((doc or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == sorted(want)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    assert back[1] == "Hello world" and back[2] == "" and back[4] == rows[-1][1]
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
    assert public_tokenizers.path("byte_bpe_multi_50k.tiktoken") == PATH
