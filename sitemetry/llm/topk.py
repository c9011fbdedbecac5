"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers. The index cuts the vectors into blocks and stores, for
every attribute and binary digit, a bitmap over the block's rows. A query's scores for all rows
of a block are the weighted sum of those bitmaps, added digit by digit with full adders on whole
bitmaps; the sum is bit-sliced itself. The top rows are then selected from its most significant
slice downward: rows with the digit set come before those without. Rows that tie at the boundary
are taken by smaller id, and the few selected rows are scored exactly. Every row is indexed and
no row is skipped, so the result is exact.

The index is built and searched in one pass: the vectors are dealt out by block, and behind a
block's vectors come the queries, the small side, which are sent to every block. Each query takes
``k`` rows from each block, whatever values the vectors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes of an index block at most, about: the larger the blocks, the fewer times queries are sent. Small tables
#: are cut into BLOCKS blocks of at least LEAST_ROWS rows, so that several tasks share the work.
INDEX_ROWS, INDEX_BYTES, BLOCKS, LEAST_ROWS = 131_072, 64_000_000, 8, 2_048


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q) with q = floor(scale * x), without vectors that are null or hold null or non-finite components.

    Components are 64-bit integers; the query fails on one that doesn't fit, it is never changed.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fits = lambda y: F.when((y >= -(2.0**63)) & (y < 2.0**63), F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("bigint"))
    q = F.transform("embedding", lambda x: fits(x.cast("double") * scale))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), q.alias("q"))


def slice_block(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps (dims, digits, words) of values (rows, dims) and the offset that makes them non-negative."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    digits = max(1, (high - low).bit_length())
    raised = np.ascontiguousarray((values.astype(np.int64).view(np.uint64) - np.uint64(low % 2**64)).T)  # wraps to the right value
    rows = values.shape[0]
    packed = np.zeros((values.shape[1], digits, -(-rows // 64) * 8), np.uint8)
    for s in range(digits):
        packed[:, s, : -(-rows // 8)] = np.packbits(((raised >> np.uint64(s)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.uint64), low


def add_slices(columns: list[list[np.ndarray]]) -> np.ndarray:
    """Slices of the sum; ``columns[w]`` holds stacks of bitmaps of weight 2**w."""
    out, w = [], 0
    while w < len(columns):
        stack = np.concatenate(columns[w]) if len(columns[w]) > 1 else columns[w][0] if columns[w] else None
        if stack is None or not len(stack):
            out.append(None)
            w += 1
            continue
        if len(columns) == w + 1 and len(stack) > 1:
            columns.append([])
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                columns[w + 1].append((a & b) | (half & c))
                stack = np.concatenate((half ^ c, stack[3 * n :]))
            else:
                columns[w + 1].append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
        w += 1
    width = next(x for x in out if x is not None).shape[0]
    return np.array([np.zeros(width, np.uint64) if x is None else x for x in out])


def score_slices(planes: np.ndarray, query: np.ndarray) -> np.ndarray | None:
    """Slices of the query's scores for all rows, up to one constant; None if all scores are equal."""
    digits = planes.shape[1]
    plain = query.astype(np.int64).view(np.uint64)
    weights = np.where(query < 0, ~plain + np.uint64(1), plain)
    # A negative weight adds the complement of its attribute instead: the same up to a constant.
    signed = planes ^ np.where(query < 0, np.uint64(2**64 - 1), np.uint64(0))[:, None, None]
    columns: list[list[np.ndarray]] = [[] for _ in range(digits + int(weights.max(initial=0)).bit_length())]
    for bit in range(int(weights.max(initial=0)).bit_length()):
        chosen = signed[(weights >> np.uint64(bit)) & np.uint64(1) == 1]
        if len(chosen):
            for s in range(digits):
                columns[bit + s].append(chosen[:, s])
    return add_slices(columns) if any(columns) else None


def _first_bits(bitmap: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n set bits."""
    words = np.flatnonzero(bitmap)[:n]
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
    at, bit = np.nonzero(bits)
    return (words[at] * 64 + bit)[:n]


def select_top(slices: np.ndarray | None, alive: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest rows among ``alive``; boundary ties go to the first places."""
    chosen, edge = np.zeros_like(alive), alive.copy()
    have = 0
    for s in [] if slices is None else slices[::-1]:
        ones = edge & s
        n = int(np.bitwise_count(ones).sum())
        if have + n > k:
            edge = ones
        else:
            chosen |= ones
            have += n
            edge &= ~s
            if have == k:
                return _first_bits(chosen, k)
    return np.concatenate((_first_bits(chosen, have), _first_bits(edge, k - have)))


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with the query; in arbitrary precision where 64 bits could overflow."""
    most = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if most(values) * most(query) * len(query) < 2**63:
        return values @ query
    exact = values.astype(object) @ query.astype(object)
    if any(not -(2**63) <= x < 2**63 for x in exact):
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


class Block:
    """The index of one block: bitmaps and values of rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.planes, _ = slice_block(values)
        self.everyone = np.packbits(np.arange(self.planes.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the query's k best rows but its own."""
        alive = self.everyone.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1]).tolist()):
            alive[own // 64] &= ~np.uint64(1 << (own % 64))
        best = select_top(score_slices(self.planes, query), alive, k)
        return self.ids[best], exact_scores(self.values[best], query)


def _padded(column: pa.ListArray, dims: int) -> np.ndarray:
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return out


def _search(dims: int, k: int):
    """Rows (query_id, vec_id, score) from (block, is_query, vec_id, q), sorted by all but q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, values, index = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
            vec, q = batch.column(2).to_numpy(), _padded(batch.column(3), dims)
            found = []
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys, axis=0).any(axis=1)) + 1):
                if not len(part):
                    continue
                block, is_query = keys[part[0]]
                if block != current:
                    current, ids, values, index = block, [], [], None
                if not is_query:
                    ids.append(vec[part])
                    values.append(q[part])
                elif ids:
                    index = index or Block(np.concatenate(ids), np.concatenate(values))
                    for i in part:
                        found.append((int(vec[i]), *index.top(int(vec[i]), q[i], k)))
            if found:
                owner = np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products among all other vectors.

    ``vectors`` and ``queries`` hold (vec_id, q). A query's own row is the one of its vec_id.

    Defined cases: ties go to the smaller vec_id; a shorter vector counts as filled up with zeros; a
    vec_id that occurs more than once is a candidate each time, and as a query only by its smallest
    vector; with fewer than k candidates all are returned; no vectors or no queries give no rows.
    """
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dims")).first()
    rows, dims = stats["n"], max(1, stats["dims"] or 0)
    size = max(1, min(INDEX_ROWS, INDEX_BYTES // (10 * dims)))  # a component has 8 bytes and its bitmaps about two
    blocks = max(1, -(-rows // size), min(BLOCKS, rows // LEAST_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    indexed = vectors.select(block, F.lit(False).alias("is_query"), "vec_id", "q")
    wanted = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "vec_id", "q")
    dealt = indexed.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "is_query", "vec_id")
    local = dealt.mapInArrow(_search(dims, k), "query_id bigint, vec_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
