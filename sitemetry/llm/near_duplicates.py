"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. *Sketch.* Each text becomes its set of word n-grams (hashed to 64 bits), MinHash values and
   from those the hashes of its bands. Texts with the same words are one class.
2. *Bands.* Classes are shuffled on (band, hash); only hashes shared by two classes go on.
3. *Verification.* A bucket is cut into blocks of about ``BLOCK_GRAMS`` n-grams by a hash of the class,
   and each pair of blocks is one unit of work: its pairs are compared on their full n-gram sets
   inside the task. A pair that shares several bands is counted in the first of them. No pair is
   ever a row: a block pair returns one row for each class in it, with its number of links there
   and the smallest class it reaches. So a bucket with a third of all texts is spread over many
   tasks and its result grows with the bucket, not with its square.
4. *Groups.* Connected components of those rows, by repeated joins with checkpoints.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut_lineage, join_counted, measured, pieces

#: Words in an n-gram and the least similarity of a link.
N, SIMILARITY = 5, 0.8
#: Share of pairs at exactly that similarity that the bands must find, and bands at most.
RECALL, MAX_BANDS = 0.999, 16
#: N-grams and classes in one block of a bucket, about: they bound what a task holds, and how often a set is sent.
BLOCK_GRAMS, BLOCK = 1 << 18, 1024
#: N-grams that a membership matrix spans at a time, and words whose hashes a task remembers: they bound its memory.
WIDTH, REMEMBERED = 2048, 100_000
#: Bytes of a row's name (id and hash of its text) in a broadcast, about.
ROW_BYTES = 48

_WORDS = re.compile(r"[^\W_]+").findall


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most selective banding that meets the recall with at most ``most`` bands."""
    best = None
    for rows in range(1, 65):
        missed = 1 - similarity**rows
        bands = 1 if missed <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(missed)))
        if bands <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding meets the recall with so few bands")
    return best


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORDS(text.lower())


class _Grams:
    """Hashes of word n-grams; remembers a bounded number of words' hashes."""

    def __init__(self, n: int):
        self.n = n
        self.seen: dict[str, int] = {}
        self.factors = np.random.default_rng(11).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)

    def word(self, word: str) -> int:
        value = self.seen.get(word)
        if value is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            value = self.seen[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return value

    def of(self, words: list[str]) -> np.ndarray:
        """Sorted distinct hashes; one n-gram of all words if there are fewer than n."""
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.word, words), np.uint64, len(words))
        n = min(self.n, len(codes))
        total = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            total += codes[k : len(codes) - n + 1 + k] * self.factors[k]
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(total ^ (total >> np.uint64(32)))


def _band_hashes(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash values by multiply-add functions of the upper and lower halves, folded by band."""
    least = np.empty(len(factors), np.uint64)
    for at in range(0, len(grams), 4096):  # bounds the working memory
        piece = grams[at : at + 4096]
        low = (piece[None, :] * factors[:, None] + offsets[:, None]).min(axis=1)
        least = low if at == 0 else np.minimum(least, low)
    folded = np.zeros(bands, np.uint64)
    for r in range(rows):
        folded = (folded ^ least.reshape(bands, rows)[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        folded ^= folded >> np.uint64(31)
    return folded


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, words_id, size, bands): hash of the text, 128-bit name of its words, number of n-grams, band hashes; null without words."""
    random = np.random.default_rng(7)
    factors = random.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)
    offsets = random.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(n)
        for batch in pieces(batches):
            names, sizes, sketches = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text) if text else []
                if not words:
                    names.append(None)
                    sizes.append(0)
                    sketches.append(None)
                    continue
                names.append(hashlib.blake2b(" ".join(words).encode(), digest_size=16).hexdigest())
                found = grams.of(words)
                sizes.append(len(found))
                sketches.append(_band_hashes(found, factors, offsets, bands, rows).view(np.int64))
            columns = {"words_id": pa.array(names, pa.string()), "size": pa.array(sizes, pa.int64()), "bands": pa.array(sketches, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": batch.column(1), **columns})

    return _doc_texts(docs).mapInArrow(run, "doc_id bigint, text_key bigint, words_id string, size bigint, bands array<bigint>")


def _doc_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): id and hash of the text name a row; rows that share both are alike."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _is_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))


def _gram_sets(texts: DataFrame, n: int) -> DataFrame:
    """(words_id, grams) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(n)
        for batch in pieces(batches):
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            names = [hashlib.blake2b(" ".join(w).encode(), digest_size=16).hexdigest() for w in words]
            sets = [grams.of(w).view(np.int64) for w in words]
            yield pa.RecordBatch.from_pydict({"words_id": pa.array(names, pa.string()), "grams": pa.array(sets, pa.list_(pa.int64()))})

    return texts.mapInArrow(run, "words_id string, grams array<bigint>")


def _similar(rows: list[np.ndarray], columns: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs have at least that Jaccard similarity, by products of membership matrices."""
    sizes_a, sizes_b = np.array([len(x) for x in rows]), np.array([len(x) for x in columns])
    shared = np.zeros((len(rows), len(columns)), np.float32)
    _, codes = np.unique(np.concatenate([*rows, *columns]), return_inverse=True)
    cuts = np.cumsum([len(x) for x in (*rows, *columns)])[:-1]
    parts = np.split(codes, cuts)
    width = int(codes.max()) + 1 if len(codes) else 0
    for at in range(0, width, WIDTH):
        a, b = np.zeros((len(rows), min(WIDTH, width - at)), np.float32), np.zeros((len(columns), min(WIDTH, width - at)), np.float32)
        for matrix, sets in ((a, parts[: len(rows)]), (b, parts[len(rows) :])):
            for i, p in enumerate(sets):
                matrix[i, p[(p >= at) & (p < at + WIDTH)] - at] = 1
        shared += a @ b.T
    union = sizes_a[:, None] + sizes_b[None, :] - shared
    return shared >= similarity * union - 1e-6


def _few_similar(rows: list[np.ndarray], columns: list[np.ndarray], todo: np.ndarray, similarity: float) -> np.ndarray:
    out = np.zeros_like(todo)
    for i, j in np.argwhere(todo):
        a, b = rows[i], columns[j]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
            continue
        both = np.concatenate((a, b))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        out[i, j] = shared >= similarity * (len(a) + len(b) - shared) - 1e-6
    return out


def _verify_block(names: list[str], sides: np.ndarray, band: int, bands: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[str, int, str]]:
    """Rows (class, links, smallest class reached) of one pair of blocks; side 2 means both blocks are one."""
    own = bool((sides == 2).all())
    left = np.arange(len(names)) if own else np.flatnonzero(sides == 0)
    right = left if own else np.flatnonzero(sides == 1)
    if not len(left) or not len(right) or (own and len(left) < 2):
        return []
    todo = np.ones((len(left), len(right)), bool)
    if own:
        todo = np.triu(todo, 1)
    for earlier in range(band):  # pairs of an earlier band are counted there
        todo &= bands[left, earlier][:, None] != bands[right, earlier][None, :]
    n = int(todo.sum())
    if n == 0:
        return []
    a, b = [grams[i] for i in left], [grams[i] for i in right]
    linked = _few_similar(a, b, todo, similarity) if n <= 4 * (len(a) + len(b)) else _similar(a, b, similarity) & todo
    at, to = np.nonzero(linked)
    if not len(at):
        return []
    links, root = np.zeros(len(names), np.int64), list(range(len(names)))
    np.add.at(links, left[at], 1)
    np.add.at(links, right[to], 1)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left[at].tolist(), right[to].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            lo, hi = (x, y) if names[x] < names[y] else (y, x)
            root[hi] = lo
    return [(names[i], int(links[i]), names[find(i)]) for i in np.flatnonzero(links)]


def _links(blocks: DataFrame, similarity: float) -> DataFrame:
    """(words_id, links, reached) of rows sorted by block pair; a task holds one block pair at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        out: list[tuple[str, int, str]] = []

        def close() -> None:
            if len(held) > 1:
                out.extend(_verify_block([h[0] for h in held], np.array([h[1] for h in held]), key[0], np.array([h[2] for h in held]), [h[3] for h in held], similarity))

        def flush() -> pa.RecordBatch:
            names, links, reached = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_pydict({"words_id": pa.array(names, pa.string()), "links": pa.array(links, pa.int64()), "reached": pa.array(reached, pa.string())})

        for batch in batches:
            c = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            keys = list(zip(*(c[k].to_pylist() for k in ("band", "hash", "p", "q")), strict=True))
            names, sides = c["words_id"].to_pylist(), c["side"].to_pylist()
            for i, k in enumerate(keys):
                if k != key:
                    close()
                    key, held = k, []
                held.append((names[i], sides[i], c["bands"][i].values.to_numpy(), c["grams"][i].values.to_numpy()))
            if len(out) >= 1000:
                yield flush()
        close()
        yield flush()

    return blocks.mapInArrow(run, "words_id string, links bigint, reached string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of its component.

    Every round links each neighbour above a node to the node's smallest neighbour, then each one
    below; rounds grow with the logarithm of the longest path.
    """
    count = F.count(F.lit(1)).alias("n")
    edges = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found = _state(edges)
    while True:
        # Edges point from the greater to the smaller node. A node's smaller neighbours give its least one...
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        # ...to which each greater neighbour is linked instead of the node.
        large = join_counted(edges.select(F.col("a").alias("up"), F.col("b").alias("a")), cut_lineage(low.where("n > 0")), ["a"], found[0]).select(F.col("up").alias("a"), F.col("low").alias("b")).distinct()
        large = cut_lineage(large)
        down = cut_lineage(large.groupBy("a").agg(F.min("b").alias("low"), count))
        small = join_counted(large, down, ["a"], large.count()).select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        edges = cut_lineage(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a != b").distinct())
        before, found = found, _state(edges)
        if before == found:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _classes(docs: DataFrame, n: int, similarity: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sketches of all rows; (words_id, copy_id, rows, root, links) of all classes; (root, class_id, stays) of all groups.

    ``stays`` names the row that stands for a group: smallest doc_id (null comes last), then hash of the text.
    """
    bands, rows = choose_bands(similarity, recall)
    sketches = cut_lineage(sketch(docs, n, bands, rows))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = sketches.where("words_id is not null").groupBy("words_id").agg(F.min("doc_id").alias("copy_id"), F.min(row).alias("stays"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    classes = cut_lineage(classes)
    exploded = classes.select("words_id", "size", F.posexplode("bands").alias("band", "hash"))
    blocks = F.greatest(F.ceil(F.sum("size") / BLOCK_GRAMS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")
    shared = cut_lineage(exploded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).where("n > 1"))
    members = cut_lineage(join_counted(exploded.drop("size"), shared, ["band", "hash"], shared.agg(F.sum("n")).first()[0] or 0))
    candidates = members.select("words_id").distinct().join(classes, "words_id").select("words_id", "stays", "bands")
    wanted = measured(candidates.select(F.col("stays.doc_id").alias("__id"), F.col("stays.text_key").alias("__key")), ROW_BYTES)
    texts = _doc_texts(docs).where("text is not null").join(wanted, _is_row(), "left_semi").select("text")
    sets = candidates.select("words_id", "bands").join(_gram_sets(texts, n).dropDuplicates(["words_id"]), "words_id")
    spread = members.join(sets, "words_id").withColumn("own", F.pmod(F.xxhash64("words_id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    placed = spread.select("band", "hash", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "words_id", side.alias("side"), "bands", "grams")
    key = ["band", "hash", "p", "q"]
    found = cut_lineage(_links(placed.repartition(*key).sortWithinPartitions(*key), similarity))
    roots = components(found.select(F.col("words_id").alias("a"), F.col("reached").alias("b")))
    linked = found.groupBy("words_id").agg(F.sum("links").alias("links"))
    grouped = classes.select("words_id", "copy_id", "stays", "rows").join(roots.withColumnRenamed("node", "words_id"), "words_id", "left").join(linked, "words_id", "left")
    grouped = cut_lineage(grouped.select("words_id", "copy_id", "stays", "rows", F.coalesce("root", "words_id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    labels = grouped.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("stays").alias("stays"))
    return sketches, grouped.drop("stays"), labels


def near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, class_id, copy_id, links).

    ``copy_id`` is the smallest doc_id among texts with the same words in the same order, ``links``
    the number of other such classes with at least that Jaccard similarity of word n-grams, and
    ``class_id`` the smallest doc_id in the connected group of links.

    Defined cases: a text of fewer than n words has one n-gram of all its words; null texts and
    texts without a letter or digit have no link and are classes of their own; rows with the same
    doc_id are judged each by its own text; a null doc_id is kept, with nulls for its ids if it
    stands alone; an empty table gives an empty one; other columns are not read.
    """
    sketches, grouped, labels = _classes(docs, n, similarity, recall)
    named = cut_lineage(grouped.join(labels.drop("stays"), "root").select("words_id", "copy_id", "class_id", "links", F.col("rows").alias("n")))
    rows = sketches.select("doc_id", "words_id")
    worded = join_counted(rows.where("words_id is not null"), named, ["words_id"], named.agg(F.sum("n")).first()[0] or 0)
    out = worded.unionByName(rows.where("words_id is null"), allowMissingColumns=True)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row of their group stands for.

    The row of smallest doc_id stays, of rows that share it the one of smallest text hash, and one of
    wholly equal rows; a null doc_id comes after all others. Rows are told apart by doc_id and text,
    so rows that share a doc_id are judged each by its own text. Null texts and texts without words
    all stay; an empty table gives an empty one; all columns are kept, whatever their names.
    """
    sketches, _, labels = _classes(docs, N, SIMILARITY, RECALL)
    worded = sketches.where("words_id is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    stays = cut_lineage(labels.select(F.col("stays.doc_id").alias("__id"), F.col("stays.text_key").alias("__key")))
    named = lambda rows: measured(rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), ROW_BYTES)
    # Rows that occur more than once leave with the others; one of each that stands for its group comes back.
    repeated = named(worded.where("rows > 1").join(stays, _is_row(), "left_semi"))
    found = named(worded.join(stays, _is_row(), "left_anti").select("doc_id", "text_key").union(worded.where("rows > 1").join(stays, _is_row(), "left_semi").select("doc_id", "text_key")))
    kept = _join_rows(docs, found, "left_anti")
    if repeated.isEmpty():
        return kept
    again = _join_rows(docs, repeated, "left_semi")
    whole = F.struct(*docs.columns)
    one = again.groupBy(F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def _join_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with (__id, __key) of rows."""
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__key"))
    return docs.join(rows, same, how)
