"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut by the tokenizer's pattern; each match is encoded by itself. Inside a match
the leaves of a segment tree stand for byte positions and hold the merge rank of the pair
that starts there; the root is the leftmost pair of lowest rank. A merge changes the pair
at its place and at the live neighbour before it and retires the place of its right half:
three point updates of logarithmic cost. A match of n bytes takes O(n log n), so a match
of a megabyte is no special case.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import pieces

#: Matches in each of the two generations that a worker remembers.
CACHED_MATCHES = 200_000
#: Longer matches are encoded each time, so that the memory is bounded in bytes as well.
CACHED_BYTES = 64


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a ``.tiktoken`` file: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encode_match(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the pattern."""
    n = len(data)
    if n == 0:
        return []
    if (whole := ranks.get(data)) is not None:
        return [whole]
    none = len(ranks) * n + n  # above every key
    rank_of = ranks.get
    # A key is rank * n + position: its minimum is the leftmost pair of lowest rank.
    keys = [none if (rank := rank_of(data[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    size = 1 << (n - 1).bit_length()
    level = keys + [none] * (size - n + 1)
    levels = [level]
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        levels.append(level)
    tree = [none, *chain.from_iterable(reversed(levels))]  # node v has the children 2v and 2v + 1
    end = list(range(1, n + 1))  # the token at i covers data[i:end[i]]
    before = list(range(-1, n))

    while (low := tree[1]) < none:
        i = low % n
        j = end[i]
        end[i] = right = end[j]
        before[right] = i
        k = before[i]
        rank = rank_of(data[i : end[right]]) if right < n else None
        changed = [(j, none), (i, none if rank is None else rank * n + i)]
        if k >= 0:
            rank = rank_of(data[k:right])
            changed.append((k, none if rank is None else rank * n + k))
        for at, key in changed:
            node = size + at
            tree[node] = key
            while node > 1:
                sibling = tree[node ^ 1]
                if sibling < key:
                    key = sibling
                node >>= 1
                if tree[node] == key:
                    break
                tree[node] = key
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i : end[i]]])
        i = end[i]
    return ids


def _ranges(chars: str) -> str:
    """The inside of a character class for sorted characters."""
    spans: list[list[int]] = []
    for code in map(ord, chars):
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


#: Texts whose characters all lie below this (Latin scripts) are cut by the faster matcher.
LATIN_END = 0x250


def pattern_finder(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of the pattern, by the standard library's matcher where it can do the same.

    For texts of Latin letters the Unicode classes are spelled out as ranges, taken from
    ``regex``; the standard library's matcher is more than twice as fast on those. Other texts,
    or a pattern with other constructs, go to ``regex`` itself.
    """
    every = "".join(map(chr, range(LATIN_END)))
    inside = {name: _ranges("".join(regex.findall(name, every))) for name in set(re.findall(r"\\[pP]\{\w+\}|\\[sS]", pattern))}
    out, in_class = [], False
    for piece in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        if piece in inside:
            out.append(inside[piece] if in_class else f"[{inside[piece]}]")
            continue
        in_class = piece == "[" or (in_class and piece != "]")
        out.append(piece)
    general = regex.compile(pattern).findall
    try:
        latin = re.compile("".join(out)).findall
    except re.error:
        return general
    beyond = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
    return lambda text: general(text) if beyond(text) else latin(text)


class _Matches(dict):
    """Ids of matches, computed when first asked for.

    Two generations bound the memory: when the young one is full it becomes the old one, and what
    is asked for again moves back to the young.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.old.get(match)
        if ids is None:
            data = match.encode()
            ids = tuple(encode_match(data, self.ranks))
            if len(data) > CACHED_BYTES:
                return ids
        if len(self) >= CACHED_MATCHES:
            self.old = dict(self)
            self.clear()
        self[match] = ids
        return ids


class Codec:
    """Encodes and decodes texts; remembers a bounded number of short matches."""

    def __init__(self, raw_ranks: bytes, pattern: str):
        self.ranks = read_ranks(raw_ranks)
        self.cut = pattern_finder(pattern)
        self.words = _Matches(self.ranks)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.name_of = {v: str(v) for v in self.ranks.values()}

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.cut(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker, kept between tasks."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str):
    """The rank file as a broadcast: a vocabulary file, about a megabyte whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, ids_sha256, decoded_sha256), one for each row of ``docs``.

    ``ids_sha256`` hashes the decimal ids joined by commas, ``decoded_sha256`` the bytes that
    the ids decode to. With ``keep_ids`` false the ids themselves stay in the task.

    Defined cases: a null or empty text has no ids, and both digests are those of the empty
    string; a null doc_id is kept; repeated rows are encoded each; an empty table gives an
    empty one; other columns of ``docs`` are not read.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        name_of = codec.name_of.__getitem__
        for batch in pieces(batches):
            ids_out, counts, ids_sha, text_sha = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(name_of, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    ids_out.append(ids)
            columns = {"doc_id": batch.column(0)}
            if keep_ids:
                columns["ids"] = pa.array(ids_out, pa.list_(pa.int32()))
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, " + "ids array<int>, " * keep_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    vocabulary = _vocabulary(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary.value, pattern)
        for batch in pieces(batches):
            texts = [None if ids is None else codec.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")
