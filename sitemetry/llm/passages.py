"""Substring deduplication by sliding spans of sentences.

1. *Units.* A text is cut into sentences: they end at a sentence mark of any script and at the
   end of a line. A sentence of more than ``LONG`` words (a table, a transcript without marks) is
   cut further after its anchor words, and every ``LONG`` words where none comes. Whether a word is
   an anchor depends on the word alone, so a passage is cut at the same words wherever it stands.
2. *Spans.* From every unit the shortest run onwards, and to every unit the shortest run up to
   it, of at least ``SPAN`` units and ``MIN_WORDS`` words is hashed to 96 bits over its
   lower-cased letters and digits. So every run that long has all its units in spans.
3. *Global join.* Spans are written once. The first occurrence of a span, by (doc_id, place),
   stays; units covered by any other occurrence go. Spans that pile up beyond a bound are few by
   that bound and meet their occurrences in a broadcast join; the others meet in a shuffled one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut_lineage, join_counted, measured, pieces, shared_table

#: Units in a span and words in a span, at least.
SPAN, MIN_WORDS = 2, 20
#: A sentence of more words is cut after its anchors: one word in ANCHOR, by its MD5.
LONG, ANCHOR = 40, 16

# Unicode ranges of scripts without blanks (Thai, Lao, Myanmar, Khmer, kana, Han), in
# which each character is a word; punctuation; and marks that end a sentence.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
PUNCTUATION = "!-/:-@\\[-`{-~\u2010-\u205e\u3000-\u303f\uff01-\uff0f\uff1a-\uff20"
MARKS = ".!?\u2026\u3002\uff01\uff1f\u0964\u0965\u061f\u06d4"
BLANK = " \\t\\n\\r\\f"
#: A word with the white space before it and the marks around it; a text is its tokens and white space at its end.
TOKEN = f"[{BLANK}]*(?:[{UNSPACED}][{PUNCTUATION}]*|[^{BLANK}{UNSPACED}]+)"

_tokens = re.compile(TOKEN).findall
_ends = re.compile(rf"[{MARKS}][\W_]*\Z").search
_no_word = re.compile(r"[\W_]+")
_STRIPPED = " \t\n\r\f.,;:!?\"'()*#-"
WORDED, ENDS, OPENS, ANCHORED = 1, 2, 4, 8
#: Different tokens that a task remembers between texts, about.
_REMEMBERED = 1 << 17
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Words(dict):
    """Numbers of tokens, with the MD5 of each one's word and its traits."""

    def __init__(self):
        super().__init__()
        self.digests, self.traits = bytearray(), bytearray()

    def __missing__(self, token: str) -> int:
        word = token.lower().strip(_STRIPPED)
        if not word.isalnum():
            word = _no_word.sub("", word)
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        ends = not token[-1].isalnum() and _ends(token) is not None
        self.digests += digest
        self.traits.append((word != "") * WORDED + ends * ENDS + ("\n" in token) * OPENS + (digest[0] < 256 // ANCHOR) * ANCHORED)
        k = self[token] = len(self)
        return k


class Reader:
    """Cuts texts into units and hashes their spans; remembers a bounded number of tokens between texts."""

    def __init__(self):
        self.words = _Words()
        self.powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
        self.inverses = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def _tables(self, n: int) -> None:
        """Powers of both bases and of their inverses, up to the n-th."""
        if n < len(self.powers[0]):
            return
        for i, base in enumerate(_BASES):
            inverse = np.uint64(pow(int(base), -1, 2**64))
            for tables, factor in ((self.powers, base), (self.inverses, inverse)):
                steps = np.full(2 * n + 1, factor, np.uint64)
                steps[0] = 1
                tables[i] = np.cumprod(steps)

    def units(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the word tokens, the first word of each unit, and the place in the text where each unit starts."""
        if len(self.words) > _REMEMBERED:
            self.words = _Words()
        tokens = _tokens(text)
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        traits = np.frombuffer(self.words.traits, np.uint8)[ids]
        worded = traits & WORDED > 0
        before = traits & OPENS > 0
        before[1:] |= (traits & ENDS > 0)[:-1]
        sentence = np.cumsum(before)[worded]
        places = np.concatenate(([0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))))[:-1][worded]
        if not len(sentence):
            return ids[:0], places, places
        new = np.zeros(len(sentence), bool)
        new[0] = True
        new[1:] = np.diff(sentence) > 0
        number = np.cumsum(new) - 1
        long = (np.bincount(number) > LONG)[number]
        if long.any():
            new[1:] |= (long & (traits[worded] & ANCHORED > 0))[:-1]
            within = np.arange(len(new)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            new |= long & (within % LONG == 0)
        first = np.flatnonzero(new)
        starts = places[first]
        starts[0] = 0
        return ids[worded], first, starts

    def spans(self, text: str) -> tuple[np.ndarray, ...]:
        """(a, b, at, to, start, stop) of every span: its hash, its units from ``at`` up to ``to``, and their part of the text."""
        ids, first, places = self.units(text)
        n = len(first)
        if n < SPAN:
            return (np.empty(0, np.int64),) * 6
        ends = np.append(first[1:], len(ids))  # words up to the end of each unit
        at = np.arange(n)
        to = np.maximum(at + SPAN - 1, np.searchsorted(ends, first + MIN_WORDS))
        back = np.minimum(at - SPAN + 1, np.searchsorted(first, ends - MIN_WORDS, side="right") - 1)
        runs = np.unique(np.concatenate((at[to < n] * n + to[to < n], back[back >= 0] * n + at[back >= 0])))
        head, last = runs // n, runs % n
        self._tables(len(ids))
        digests = np.frombuffer(self.words.digests, np.uint64).reshape(-1, 2)[ids]
        hashes = []
        for i in range(2):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digests[:, i] * self.powers[i][: len(ids)])))
            h = (sums[ends[last]] - sums[first[head]]) * self.inverses[i][first[head]]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append((h ^ (h >> np.uint64(29))).view(np.int64))
        places = np.append(places, len(text))
        return hashes[0], hashes[1], head, last + 1, places[head], places[last + 1]


def spans_of(rows: DataFrame) -> DataFrame:
    """(a, b, doc, text_hash, units, chars): every span of (doc, text_hash, text).

    ``a`` and ``b`` are its hash. ``units`` and ``chars`` hold two numbers each, the first 32 bits higher:
    where it starts and where it ends, in units and in the text. Spans are many, so they are kept narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in pieces(batches, 64):
            found = [reader.spans(text) for text in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            a, b, at, to, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
            docs, keys = batch.column(0).to_numpy()[owner], batch.column(1).to_numpy()[owner]
            columns = [a, (b >> 32).astype(np.int32), docs, keys, (at << 32) | to, (start << 32) | stop]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "doc", "text_hash", "units", "chars"])

    schema = "a bigint, b int, doc bigint, text_hash bigint, units bigint, chars bigint"
    return rows.select("doc", "text_hash", "text").where("text is not null").mapInArrow(run, schema)


def _head(pair: Column) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _tail(pair: Column) -> Column:
    return pair.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _joined(spans: Column) -> Column:
    """Parts (at, to, start, stop) that sorted spans cover together; spans that start later don't end earlier."""
    apart = lambda x, y: F.coalesce(_head(y["units"]) > _tail(x["units"]), F.lit(True))
    heads = F.filter(spans, lambda x, i: (i == 0) | apart(F.get(spans, i - 1), x))
    tails = F.filter(spans, lambda x, i: apart(x, F.get(spans, i + 1)))
    part = lambda h, t: F.struct(_head(h["units"]).alias("at"), _tail(t["units"]).alias("to"), _head(h["chars"]).alias("start"), _tail(t["chars"]).alias("stop"))
    return F.zip_with(heads, tails, part)


def covered_parts(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, parts): what each row's spans cover that are not the first occurrence."""
    with shared_table(spans_of(rows), "spans") as spans:
        place = F.struct("doc", "text_hash", _head(F.col("units")).alias("at"))
        repeated = spans.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        repeated = cut_lineage(repeated.where("n > 1"))
        met = join_counted(spans, repeated, ["a", "b"], spans.count())
        later = met.where(place != F.col("first")).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set(F.struct("units", "chars"))).alias("spans"))
        return cut_lineage(later.select("doc", "text_hash", _joined(F.col("spans")).alias("parts")))


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, parts: pd.Series) -> pd.Series:
    """Texts without their parts; null where there are none."""

    def left(text: str, parts: list[dict]) -> str:
        edges = [0, *(x for p in parts for x in (p["start"], p["stop"])), len(text)]
        return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).lstrip(" \t\n\r\f")

    return pd.Series([None if p is None else left(t, p) for t, p in zip(text, parts, strict=True)], dtype=object)


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``removed_units`` (how many units).

    Texts that lose nothing are returned as they were, to the letter.

    Defined cases: a null text stays null and an empty one empty; texts of fewer than ``SPAN`` units
    or ``MIN_WORDS`` words have no span; a text that lost everything is empty and its row stays;
    occurrences tie by hash of the text where doc_ids are equal, and wholly equal rows count as one,
    so none of them loses to the other; a null doc_id comes before all others; other columns are
    kept; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != "removed_units"]
    names = {c: f"__in_{i}" for i, c in enumerate(kept)}
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    covered = measured(covered_parts(rows), 64 + 48 * F.size("parts"))
    found = rows.join(covered, ["doc", "text_hash"], "left").withColumn("hit", F.col("parts").isNotNull())
    text = F.when(F.col("hit"), _without(F.when(F.col("hit"), F.col("text")), F.col("parts"))).otherwise(F.col("text"))
    removed = F.when(F.col("hit"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["to"] - p["at"])).otherwise(F.lit(0).cast("bigint"))
    return found.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in names.items()], removed.alias("removed_units"))
