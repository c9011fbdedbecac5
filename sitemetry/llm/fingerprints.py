"""Order MinHash document fingerprints (DataFrame functions only).

A text becomes the sequence of its k-mers of words. Every k-mer is numbered by its
occurrence in the text, and hashed with that number, so repeats count separately. One
permutation is split into slots: a slot takes the k-mers whose hash has the slot's leading
bits and selects its ``PER_SLOT`` smallest. The selected k-mers keep their order in the text
and the tuple of them is hashed to the slot's signature. Since order counts, the share of
equal slots falls with the edit distance and not only with the set of k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut_lineage, measured

#: Words in a k-mer, bits that name a slot (32 slots), k-mers selected in a slot.
K, SLOT_BITS, PER_SLOT = 3, 5, 2
# Unicode ranges of scripts without blanks (Thai, Lao, Myanmar, Khmer, kana, Han), in which each character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Low bits of a value that hold the k-mer's place in the text: as many as an array can have entries.
PLACE_BITS = 31
#: Documents in one ordered piece when neighbours are looked up, about; ranges of ids that are known on the driver, at most.
PIECE_ROWS, MAX_RANGES = 1_000, 20_000

_PLACES = (1 << PLACE_BITS) - 1


def _slot(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - SLOT_BITS).cast("int")


def _numbered(hashes: Column) -> Column:
    """Hash of (k-mer, occurrence number) with its place, for texts in which k-mers repeat.

    Sorting (k-mer, place) puts the occurrences of a k-mer next to each other; the number of
    one is its distance from the start of its run.
    """
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.flatten(
        F.transform(
            F.array(ordered),
            lambda s: F.flatten(
                F.transform(
                    F.array(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j)["h"] != F.get(s, j - 1)["h"]))),
                    lambda starts: F.flatten(
                        F.transform(
                            starts,
                            lambda start, n: F.transform(
                                F.slice(s, start + 1, F.coalesce(F.get(starts, n + 1), F.size(s)) - start),
                                lambda x, o: _placed(x["h"], o, x["i"]),
                            ),
                        )
                    ),
                )
            ),
        )
    )


def _placed(kmer_hash: Column, occurrence: Column, place: Column) -> Column:
    mixed = F.xxhash64(kmer_hash, occurrence)
    return mixed.bitwiseAND(F.lit(~_PLACES)).bitwiseOR(place.cast("bigint").bitwiseAND(F.lit(_PLACES)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the column ``out``: an array of slots, null where a slot has no k-mer.

    Each step is a column of its own, so the engine computes it once.
    """
    words, kmers, values, chosen = (f"__{out}_{x}" for x in ("words", "kmers", "values", "chosen"))
    kept = df.columns
    df = df.withColumn(words, F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"([{UNSPACED}]|[^ \t\n\r\f{UNSPACED}]+)"), F.lit(1)))
    w = F.col(words)
    short = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
    full = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
    df = df.withColumn(kmers, F.when(F.size(w) < K, short).otherwise(full)).drop(words)
    h = F.col(kmers)
    once = F.transform(h, lambda x, i: _placed(x, F.lit(0), i))
    df = df.withColumn(values, F.array_sort(F.when(F.size(F.array_distinct(h)) == F.size(h), once).otherwise(_numbered(h)))).drop(kmers)
    v = F.col(values)
    first_of_slot = F.filter(v, lambda x, i: (i < PER_SLOT) | (_slot(F.get(v, i - PER_SLOT)) != _slot(x)))
    in_text_order = F.array_sort(
        F.transform(first_of_slot, lambda x: F.struct(_slot(x).alias("slot"), x.bitwiseAND(F.lit(_PLACES)).alias("place"), F.shiftrightunsigned(x, PLACE_BITS).alias("kmer")))
    )
    df = df.withColumn(chosen, in_text_order).drop(values)
    c = F.col(chosen)
    tuples = F.map_from_entries(
        F.filter(
            F.transform(
                c,
                lambda x, i: F.when(
                    (i == 0) | (F.get(c, i - 1)["slot"] != x["slot"]),
                    F.struct(x["slot"].alias("slot"), F.xxhash64(x["kmer"], *[F.when(F.get(c, i + j)["slot"] == x["slot"], F.get(c, i + j)["kmer"]) for j in range(1, PER_SLOT)]).alias("tuple")),
                ),
            ),
            lambda e: e.isNotNull(),
        )
    )
    slots = F.transform(F.array(tuples), lambda m: F.transform(F.sequence(F.lit(0), F.lit((1 << SLOT_BITS) - 1)), lambda s: F.try_element_at(m, s)))
    return df.withColumn(out, F.get(slots, 0)).select(*kept, out)


def written(fingerprint: Column) -> Column:
    """A fingerprint as text: 32 bits of each slot in hex, ``-`` for an empty slot."""
    return F.array_join(F.transform(fingerprint, lambda s: F.coalesce(F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Equal slots as a share of those that either text fills; 1 if neither fills any."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    filled = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal.cast("double") / filled)


def _range_starts(ids: DataFrame, key: str) -> list[int]:
    """First keys of ranges with about the same number of rows; a key that fills ranges alone has one to itself."""
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, n // PIECE_ROWS))
    if ranges == 1:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = ids.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 10 * ranges))).alias("p")).first()["p"] or []
    return sorted({*found, *(a + 1 for a, b in zip(found, found[1:], strict=False) if a == b and a < 2**63 - 1)})


def _numbers(values: list[int | None]) -> Column:
    """A literal array of longs, written in one piece."""
    return F.split(F.lit(",".join("null" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _range_of(key: Column, starts: list[int]) -> Column:
    """How many of the sorted starts are at or below the key, by a search in two steps."""
    if not starts:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    block = F.size(F.filter(_numbers(starts[::step]), lambda s: s <= key))
    inside = F.size(F.filter(F.slice(_numbers(starts), (block - 1) * step + 1, F.lit(step)), lambda s: s <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def _pieces(rows: DataFrame, key: str, text: str, starts: list[int]) -> DataFrame:
    """``rows`` with ``__r`` and ``__piece``: pieces in the order of (key, hash of the text).

    A range of keys is cut evenly between its least and greatest key, and a range of one key by the hash.
    """
    dealt = rows.withColumn("__r", _range_of(F.col(key), starts))
    facts = {r["__r"]: r for r in dealt.select("__r", key).groupBy("__r").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    of = lambda value: F.get(_numbers([value(facts[r]) if r in facts else 0 for r in range(len(starts) + 1)]), F.col("__r"))
    pieces = of(lambda f: -(-f["n"] // PIECE_ROWS))
    lo, hi = of(lambda f: f["lo"]), of(lambda f: f["hi"])
    # In doubles, so that no difference of keys overflows; rounding keeps the order.
    at = (F.col(key).cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double") + 1)
    if any(f["lo"] == f["hi"] and f["n"] > PIECE_ROWS for f in facts.values()):
        at = F.when(lo == hi, F.xxhash64(text) / F.lit(2.0**64) + 0.5).otherwise(at)
    return dealt.withColumn("__piece", F.least(pieces - 1, F.floor(at * pieces)))


def with_next(df: DataFrame, key: str, text: str, columns: dict[str, str], prepared: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` with columns of the next row by ascending (key, hash of the text, text); after the last comes the first.

    ``columns`` maps columns to the names of their copies. ``prepared`` adds columns to the rows where they
    have been dealt, so that its work is spread and its columns aren't shuffled. Rows are dealt to pieces of about
    PIECE_ROWS rows, and each piece also gets the first row of the next one. The ranges that pieces
    are cut from are known on the driver; the pieces themselves are a table that grows with ``df``.
    """
    starts = _range_starts(df.select(key), key)
    dealt = _pieces(df, key, text, starts)
    ties = any(a == b for a, b in zip(starts, [x - 1 for x in starts[1:]], strict=False))
    tie = F.xxhash64(text) if ties else F.lit(0).cast("bigint")
    bucket = ["__r", "__piece"]
    firsts = _pieces(df.select(key, text), key, text, starts).groupBy(*bucket).agg(F.min(F.struct(F.col(key).alias("k"), tie.alias("t"))).alias("__first"))
    firsts = cut_lineage(firsts)
    ends = {r["__r"]: r["p"] for r in firsts.groupBy("__r").agg(F.max("__piece").alias("p")).collect()}
    filled = sorted(ends)
    # The first row of a piece follows the last row of the piece before it; the very first follows the last.
    above = {r: filled[i - 1] for i, r in enumerate(filled)}
    ranges = range(len(starts) + 1)
    lookup = lambda value: F.get(_numbers([value(r) if r in above else 0 for r in ranges]), F.col("__r"))
    inside = F.lag("__piece").over(Window.partitionBy("__r").orderBy("__piece"))
    back = F.when(inside.isNotNull(), F.struct(F.col("__r").cast("bigint").alias("r"), inside.alias("p"))).otherwise(F.struct(lookup(lambda r: above[r]).alias("r"), lookup(lambda r: ends[above[r]]).alias("p")))
    placed = dealt.join(measured(firsts.withColumn("__back", back), 64), bucket)
    own = F.struct(F.col("__r").cast("bigint").alias("r"), F.col("__piece").alias("p"), F.lit(0).alias("extra"))
    extra = F.struct(F.col("__back.r").alias("r"), F.col("__back.p").alias("p"), F.lit(1).alias("extra"))
    is_first = (F.col("__first.k") == F.col(key)) & (F.col("__first.t") == tie)
    placed = placed.withColumn("__sent", F.explode(F.when(is_first, F.array(own, extra)).otherwise(F.array(own))))
    sent = [F.col(f"__sent.{c}").alias(f"__sent_{c}") for c in ("r", "p", "extra")]
    placed = placed.select(*df.columns, *sent, F.xxhash64(text).alias("__tie"))
    helpers = ["__sent_r", "__sent_p", "__sent_extra", "__tie"]
    placed = prepared(placed.repartition("__sent_r", "__sent_p"))
    # Plain columns, so that all copies come from one window over one shuffle.
    in_order = Window.partitionBy("__sent_r", "__sent_p").orderBy("__sent_extra", key, "__tie", text)
    copies = [F.lead(column).over(in_order).alias(name) for column, name in columns.items()]
    return placed.select("*", *copies).where("__sent_extra = 0").drop(*helpers)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likenesses.

    The edited text has the last quarter of the code points replaced by as many from the start
    of the next document by ascending doc_id. Likenesses compare the fingerprint with those of
    the edited text and of the next document.

    Defined cases: a null text is empty; an empty text has no filled slot and two of them are
    alike; equal doc_ids are ordered by hash of the text; a null doc_id comes before all others; a single
    document is followed by itself; an empty table gives an empty one; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("__key", F.coalesce("doc_id", F.lit(-(2**63))))
    joined = with_next(rows, "__key", "text", {"text": "next_text", "fp": "next_fp"}, lambda dealt: with_fingerprint(dealt, "text", "fp"))
    joined = joined.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = joined.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cut)"), F.expr("substring(next_text, 1, cut)"))).drop("text", "next_text")
    both = with_fingerprint(edited, "edited", "edited_fp")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
