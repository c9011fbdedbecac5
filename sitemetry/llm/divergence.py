"""Source divergence audit: how far the word use of each source lies from other sources and from its language.

Two readings of the corpus. The first counts exactly in how many documents of a language each term
occurs and keeps the frequent ones. These are dealt into shards of about SHARD_TERMS terms, and for each
shard a task builds a minimal perfect hash: buckets of terms with displacements that send every term
to a slot of its own, and the terms in the order of their slots. The second reading counts every
occurrence: tasks get the shards by broadcast, at most ROUND_BYTES a round, look up terms, compare them
with the stored ones, and increment dense slots by group (language and source). Slots are summed by
shard and group, and each shard's matrix of groups and slots gives its part of all divergences.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut_lineage, measured, pieces, shared_table

#: Terms of a shard, about; bytes of shards that one reading of the corpus takes along.
SHARD_TERMS, ROUND_BYTES = 8_192, 64_000_000
#: Terms and slots a task holds before it hands on what it has counted; slots it remembers by term; bytes of a text worked on at a time.
MOST_TERMS, MOST_SLOTS, MOST_KNOWN, MOST_BYTES = 400_000, 8_000_000, 400_000, 1_000_000
#: Documents of a language that must have a term; terms shown for each group; what counts are smoothed by and scaled to.
LEAST_DOCUMENTS, SHOWN, SMOOTHED, SCALE = 10, 10, 2, 1_000_000_000

#: Terms are runs of ASCII letters and of bytes beyond ASCII: A-Z to a-z, all other ASCII to blanks.
_FOLDED = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + MOST_BYTES
        part = text[at:end].translate(_FOLDED)
        while end < len(text) and part[-1] != 0x20:  # a term isn't cut
            more = text[end : end + MOST_BYTES].translate(_FOLDED)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Languages, sources and UTF-8 texts by pieces of (lang, source, text)."""
    for batch in pieces(batches):
        yield batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of (lang, source, text) with the term, counted until MOST_TERMS terms are held."""
    held: dict[str, Counter] = {}

    def handed_on() -> pa.RecordBatch:
        langs, terms, n = [], [], []
        for lang, counts in held.items():
            langs += [lang] * len(counts)
            terms += counts.keys()
            n += counts.values()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "term", "n"])

    for langs, _, texts in _texts(batches):
        for lang, text in zip(langs, texts, strict=True):
            found = set()
            for part in terms_of(text):
                found.update(part)
            held.setdefault(lang, Counter()).update(found)
        if sum(map(len, held.values())) >= MOST_TERMS:
            yield handed_on()
    if held:
        yield handed_on()


def read_columns(documents: DataFrame) -> DataFrame:
    """(lang, source, text) as text, null as empty."""
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def frequent_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of a language; counted exactly."""
    counted = read_columns(documents).mapInArrow(_document_counts, "lang string, term string, n bigint")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


# ---- minimal perfect hashes


def _hash(term: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(term, seed)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _slots(hashes: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slots of hashes under displacements; a negative displacement names the slot itself."""
    x = (hashes + shift.astype(np.uint64) * _M1) * _M2
    return np.where(shift < 0, -shift - 1, ((x ^ (x >> np.uint64(31))) % size.astype(np.uint64)).astype(np.int64))


def perfect_hash(terms: list[bytes]) -> tuple[int, np.ndarray, list[bytes]]:
    """(seed, displacements by bucket, terms by slot) of distinct terms: every slot holds one term."""
    n = len(terms)
    seed = 0
    while True:
        hashes = np.array([_hash(t, seed) for t in terms], np.uint64)
        if len(np.unique(hashes)) == n:
            break
        seed += 1  # two terms of one hash can't be told apart
    buckets = -(-n // 3)
    home = (hashes >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(home, kind="stable")
    families = np.split(order, np.flatnonzero(np.diff(home[order])) + 1)
    taken, shifts = np.zeros(n, bool), np.zeros(buckets, np.int64)
    tries = 256
    for family in sorted((f for f in families if len(f) > 1), key=len, reverse=True):
        first = 0
        while True:
            d = np.arange(first, first + tries)
            at = np.sort(_slots(hashes[family][None, :], d[:, None], np.array(n)), axis=1)
            good = ~taken[at].any(axis=1) & (np.diff(at, axis=1) > 0).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                shifts[home[family[0]]] = d[k]
                taken[at[k]] = True
                break
            first += tries
    free = iter(np.flatnonzero(~taken).tolist())
    for family in families:
        if len(family) == 1:
            shifts[home[family[0]]] = -next(free) - 1
    slots = _slots(hashes, shifts[home], np.array(n))
    return seed, shifts, [terms[i] for i in np.argsort(slots)]


_SHARDS = "lang string, shard int, seed bigint, shifts array<bigint>, terms array<string>"


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _SHARDS from (lang, shard, term) sorted by lang and shard."""

    def row(key: tuple, terms: list[bytes]) -> pa.RecordBatch:
        seed, shifts, placed = perfect_hash(terms)
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([seed]), pa.array([shifts]), pa.array([placed], pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["lang", "shard", "seed", "shifts", "terms"])

    current, held = None, []
    for batch in batches:
        for *key, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if key != current:
                if held:
                    yield row(current, held)
                current, held = key, []
            held.append(term)
    if held:
        yield row(current, held)


def hash_shards(terms: DataFrame) -> DataFrame:
    """Rows _SHARDS of (lang, term): each shard's minimal perfect hash, by the terms' own hash."""
    sizes = measured(terms.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("int").alias("shards")), 64)
    dealt = terms.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term")
    return dealt.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(_built, _SHARDS)


class Lookup:
    """The perfect hashes of some shards, sorted by language, as flat arrays."""

    def __init__(self, shards: pa.Table, counts: dict[str, int]):
        self.counts = counts  # shards of each language, those that aren't here included
        self.row = {(lang, shard): i for i, (lang, shard) in enumerate(zip(shards["lang"].to_pylist(), shards["shard"].to_pylist(), strict=True))}
        self.keys = list(self.row)
        self.seed = shards["seed"].to_numpy()
        shifts, terms = shards["shifts"].combine_chunks(), shards["terms"].combine_chunks()
        self.shift_at, self.shifts = shifts.offsets.to_numpy(), shifts.values.to_numpy()
        self.term_at, self.terms = terms.offsets.to_numpy(), terms.values.cast(pa.binary())
        self.first = {lang: i for i, (lang, _) in reversed([*enumerate(self.keys)])}
        self.last = {lang: i + 1 for i, (lang, _) in enumerate(self.keys)}
        self.rows = {lang: np.array([self.row.get((lang, s), -1) for s in range(n)]) for lang, n in counts.items()}

    def span(self, lang: str) -> tuple[int, int]:
        """The slots of a language."""
        return (int(self.term_at[self.first[lang]]), int(self.term_at[self.last[lang]])) if lang in self.first else (0, 0)

    def find(self, lang: str, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``terms``, slots) of the terms that are stored; slots count through all shards."""
        if lang not in self.counts or not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        dealt = np.array([_hash(t, 42) for t in terms], np.uint64).view(np.int64) % self.counts[lang]  # as Spark's xxhash64
        rows = self.rows[lang][dealt]
        held = np.flatnonzero(rows >= 0)
        rows = rows[held]
        hashes = np.array([_hash(terms[i], int(s)) for i, s in zip(held.tolist(), self.seed[rows].tolist(), strict=True)], np.uint64)
        buckets = self.shift_at[rows + 1] - self.shift_at[rows]
        home = (hashes >> np.uint64(32)).astype(np.int64) % np.maximum(buckets, 1)
        slots = self.term_at[rows] + _slots(hashes, self.shifts[self.shift_at[rows] + home], self.term_at[rows + 1] - self.term_at[rows])
        stored = self.terms.take(pa.array(slots)).to_pylist()
        same = np.array([terms[i] == t for i, t in zip(held.tolist(), stored, strict=True)], bool)
        return held[same], slots[same]


_COUNTS = "lang string, shard int, source string, slots array<int>, counts array<bigint>"


def _counted(sent):
    """Rows _COUNTS of (lang, source, text) for the broadcast shards: the slots that aren't zero, by shard and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, counts = sent.value
        lookup = Lookup(pa.ipc.open_stream(shards).read_all(), counts)
        cuts = lookup.term_at
        dense: dict[tuple, np.ndarray] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), slots in dense.items():
                used = np.flatnonzero(slots) + lookup.span(lang)[0]
                shard = np.searchsorted(cuts, used, side="right") - 1
                parts = np.split(np.arange(len(used)), np.flatnonzero(np.diff(shard)) + 1) if len(used) else []
                rows = [int(shard[p[0]]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(parts), pa.string()), pa.array([lookup.keys[r][1] for r in rows], pa.int32()), pa.array([source] * len(parts), pa.string()), pa.array([(used[p] - cuts[r]).astype(np.int32) for p, r in zip(parts, rows, strict=True)], pa.list_(pa.int32())), pa.array([slots[used[p] - lookup.span(lang)[0]] for p in parts], pa.list_(pa.int64()))],
                    names=[c.split()[0] for c in _COUNTS.split(", ")],
                )
            dense.clear()

        found: dict[str, dict[str, Counter]] = {}

        known: dict[str, dict[bytes, int]] = {}

        def looked_up() -> Iterator[pa.RecordBatch]:
            if sum(map(len, known.values())) > MOST_KNOWN:
                known.clear()
            for lang, by_source in found.items():
                slot_of = known.setdefault(lang, {})
                terms = [t for t in set().union(*by_source.values()) if t not in slot_of]
                at, slots = lookup.find(lang, terms)
                slot_of.update(dict.fromkeys(terms, -1))
                slot_of.update(zip((terms[i] for i in at.tolist()), slots.tolist(), strict=True))
                first, last = lookup.span(lang)
                for source, held in by_source.items():
                    if (lang, source) not in dense:
                        if dense and sum(map(len, dense.values())) + last - first > MOST_SLOTS:
                            yield from handed_on()
                        dense[lang, source] = np.zeros(last - first, np.int64)
                    own, n = np.fromiter(map(slot_of.__getitem__, held), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))
                    dense[lang, source][own[own >= 0] - first] += n[own >= 0]  # slots are distinct
            found.clear()

        for langs, sources, texts in _texts(batches):
            for lang, source, text in zip(langs, sources, texts, strict=True):
                held = found.setdefault(lang, {}).setdefault(source, Counter())
                for part in terms_of(text):
                    held.update(part)
            if sum(len(c) for by_source in found.values() for c in by_source.values()) >= MOST_TERMS:
                yield from looked_up()
        yield from looked_up()
        yield from handed_on()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _COUNTS with one row a (lang, shard, source), from rows sorted by these."""
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def row(key: list, total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, used.astype(np.int32), total[used]), kinds, strict=True)], names=names)

    current, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for key, slots, counts in zip(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True), batch.column(3), batch.column(4), strict=True):
            slots, counts = slots.values.to_numpy(), counts.values.to_numpy()
            if key != current:
                if current is not None:
                    yield row(current, total)
                current, total = key, np.zeros(0, np.int64)
            if len(slots) and slots[-1] >= len(total):
                total = np.append(total, np.zeros(int(slots[-1]) + 1 - len(total), np.int64))
            total[slots] += counts
    if current is not None:
        yield row(current, total)


def scaled_shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly, by long division; totals up to 9.2e15."""
    rest = counts + SMOOTHED
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


_PARTS = "lang string, source string, part string, item string, value bigint"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _PARTS of each (lang, shard), from (lang, shard, source, total, slots, counts, terms) sorted by the first three.

    ``total`` is the denominator of the row's shares. Each shard begins with the row of the whole language, whose
    source is null; it alone holds the shard's terms. A pair is told once, by the source that comes first.
    """

    def told(lang: str, sources: list, totals: list, sparse: list, terms: list) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(sources), len(terms)), np.int64)
        for i, (slots, n) in enumerate(sparse):
            counts[i, slots] = n
        shares = scaled_shares(counts, np.array(totals, np.int64)[:, None])
        out = []
        q = shares[0]
        for i in range(1, len(sources)):
            p = shares[i]
            above = np.flatnonzero((counts[i] > 0) & (p > q))
            value = (p[above] - q[above]) ** 2 // (p[above] + q[above])
            best = heapq.nsmallest(SHOWN, zip((-value).tolist(), (terms[s] for s in above.tolist()), strict=True))
            out += [(lang, sources[i], "term", term, -v) for v, term in best]
            if i + 1 < len(sources):
                gap = shares[i + 1 :] - p
                pairs = (gap * gap // (shares[i + 1 :] + p)).sum(axis=1)
                out += [(lang, sources[i], "pair", other, int(v)) for other, v in zip(sources[i + 1 :], pairs, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        text = lambda c: pa.array([x if isinstance(x, bytes) else x.encode() for x in c], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*[text(c) for c in columns[:4]], pa.array(columns[4], pa.int64())], names=["lang", "source", "part", "item", "value"])

    current, held = None, ([], [], [], [])
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        for (lang, shard, source, total), slots, n, terms in zip(keys, batch.column(4), batch.column(5), batch.column(6), strict=True):
            if (lang, shard) != current:
                if current is not None:
                    yield from told(current[0], *held)
                current, held = (lang, shard), ([], [], [], [t.encode() for t in terms.as_py()])
            held[0].append(source)
            held[1].append(total)
            held[2].append((slots.values.to_numpy(), n.values.to_numpy()) if slots.is_valid else (np.zeros(0, np.int64),) * 2)
    if current is not None:
        yield from told(current[0], *held)


def divergence(documents: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): see the module; ``documents`` holds (text, lang, source).

    With V kept terms in a language, a group with N of their occurrences gives a term the share
    p = 1 + floor(1e9 * (count + 2) / (N + 2 V)); two shares differ by f = floor((p - q)^2 / (p + q)).
    Part ``pair`` ranks the other sources of the language by the sum of f over all kept terms; part
    ``term`` shows the ten terms with the largest f among those that the group uses more than its language.
    Whole numbers throughout.

    Defined cases: null text, lang and source are empty; a group without terms has shares all the same;
    a language without kept terms has pairs of value 0 and no terms; ties are ranked by item; repeated
    rows count each time; no documents give no rows; other columns are not read.
    """
    spark = documents.sparkSession
    documents = read_columns(documents)
    kept = cut_lineage(frequent_terms(documents))
    shards = cut_lineage(hash_shards(kept))
    shard_counts = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("int").alias("n")).collect()}  # one row a language
    size = F.length(F.array_join("terms", "")) * 2 + F.size("terms") * 8 + F.size("shifts") * 8
    rounds = -(-(shards.agg(F.sum(size)).first()[0] or 0) // ROUND_BYTES)
    with ExitStack() as stack:
        counted = None
        for k in range(rounds):
            part = shards.where(F.pmod(F.xxhash64("lang", "shard"), F.lit(rounds)) == k).orderBy("lang", "shard").toArrow()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_table(part)
            sent = spark.sparkContext.broadcast((sink.getvalue().to_pybytes(), shard_counts))
            told = stack.enter_context(shared_table(documents.mapInArrow(_counted(sent), _COUNTS), f"slots-{k}"))
            counted = told if counted is None else counted.unionByName(told)
        if counted is None:
            counted = spark.createDataFrame([], _COUNTS)
        by = ["lang", "shard", "source"]
        summed = cut_lineage(counted.repartition(*by).sortWithinPartitions(*by).mapInArrow(_summed, _COUNTS))

    groups = cut_lineage(documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")))
    occurred = summed.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("occurrences"))
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.join(occurred, ["lang", "source"], "left").join(vocabulary, "lang").select("lang", "source", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "v")
    totals = measured(totals, F.length("lang") + F.length("source") + 24)
    denominator = (F.col("occurrences") + SMOOTHED * F.col("v")).alias("total")
    whole_totals = F.broadcast(totals.groupBy("lang").agg(F.sum("occurrences").alias("occurrences"), F.first("v").alias("v")).select("lang", denominator))  # one row a language

    # A shard's rows: its terms with the language's counts, then one row for every group, with counts or without.
    pairs = F.explode(F.arrays_zip("slots", "counts"))
    slot_sums = summed.select("lang", "shard", pairs.alias("c")).groupBy("lang", "shard", F.col("c.slots").alias("slot")).agg(F.sum("c.counts").alias("n"))
    whole = slot_sums.groupBy("lang", "shard").agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("c"))  # at most a shard's slots
    whole = shards.join(whole, ["lang", "shard"]).join(whole_totals, "lang").select("lang", "shard", F.lit(None).cast("string").alias("source"), "total", F.col("c.slot").alias("slots"), F.col("c.n").alias("counts"), "terms")
    listed = shards.select("lang", "shard").join(totals.select("lang", "source", denominator), "lang")
    by_group = listed.join(summed, by, "left").select("lang", "shard", "source", "total", "slots", "counts", F.lit(None).cast("array<string>").alias("terms"))
    rows = whole.unionByName(by_group).repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.asc_nulls_first("source"))
    parts = cut_lineage(rows.mapInArrow(_compared, _PARTS))

    summed_pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = summed_pairs.unionByName(summed_pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    empty = measured(groups.join(F.broadcast(vocabulary.select("lang")), "lang", "left_anti").select("lang", "source"), F.length("lang") + F.length("source") + 8)
    none = empty.join(empty.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("bigint").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = both.unionByName(none).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= SHOWN)
    return ranked_pairs.unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
