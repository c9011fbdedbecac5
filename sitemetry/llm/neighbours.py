"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Vectors are dealt into shards by a hash of their values, so copies of a vector meet and count as one
point of a graph. A shard's task cuts its points into bands of similar length, so that long vectors
don't blur short ones, and for each band scales them into the unit ball and adds one coordinate that
lifts them onto the sphere: the largest inner product is then the smallest distance. Points enter
a band's graph in growing batches. A beam search for the new point proposes neighbours, and robust pruning
takes the nearest one and drops all that are ``1 / RELAXED`` times as near to it as to the point, again
and again: short edges stay, and so do long ones in directions of their own. Edges are mirrored, and
points with too many are pruned again. Every query then searches every shard's graphs with a beam, the
points found are scored exactly, and the best of all shards are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut_lineage, measured

#: Bytes of vectors and edges in a shard, about; points of a shard at most. With few vectors, shards that share the work.
SHARD_BYTES, SHARD_POINTS, SHARDS, LEAST_POINTS = 64_000_000, 131_072, 12, 2_048
#: Edges of a point; places of the beam that builds and of the one that searches; how much nearer a dropped point is to the kept one.
EDGES, BUILD_BEAM, SEARCH_BEAM, RELAXED = 32, 64, 160, 1.2
#: Points whose neighbours are all compared at first; points expanded in one step; queries or points that move in step.
FIRST_POINTS, EXPANDED, IN_STEP = 1_024, 4, 256
#: How many times longer than the shortest vector of its band one may be; wider bands find less.
BAND = 1.1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without vectors that are null, zero, empty or hold null or non-finite components."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def lifted(values: np.ndarray) -> np.ndarray:
    """Points in the unit ball, lifted onto the sphere by one more coordinate: nearest is then largest inner product."""
    scaled = values / np.abs(values).max()
    square = (scaled * scaled).sum(axis=1)
    most = square.max()
    out = np.empty((len(values), values.shape[1] + 1), np.float32)
    out[:, :-1] = scaled / np.sqrt(most)
    out[:, -1] = np.sqrt(np.maximum(0.0, 1.0 - square / most))
    return out


def robust_prune(points: np.ndarray, found: np.ndarray, near: np.ndarray, edges: int = EDGES, relaxed: float = RELAXED) -> np.ndarray:
    """Edges (n, edges), -1 behind the last, from candidates (n, c) and their squared distances, inf where there is none.

    The nearest candidate is kept, and those drop out that it is ``relaxed`` times nearer to than the point is.
    """
    n, c = found.shape
    rows = np.arange(n)
    candidates = points[found]
    between = 2.0 - 2.0 * (candidates @ candidates.transpose(0, 2, 1))  # points have length 1
    left, out = near.copy(), np.full((n, edges), -1, np.int32)
    limit = near / (relaxed * relaxed)
    for k in range(min(edges, c)):
        best = left.argmin(axis=1)
        live = np.isfinite(left[rows, best])
        if not live.any():
            break
        out[live, k] = found[rows, best][live]
        left[between[rows, best] <= limit] = np.inf
        left[rows, best] = np.inf
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the ``beam`` points nearest to each target that a greedy walk finds, nearest first.

    The nearest points that weren't expanded yet are expanded until the whole beam was; ``targets`` move in step.
    """
    n = len(targets)
    found = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    found[:, 0], near[:, 0] = start, 2.0 - 2.0 * (targets @ points[start])
    seen = np.zeros((n, len(points) + 1), bool)  # the last place takes what is no point
    seen[:, start] = seen[:, -1] = True
    moving = np.arange(n)
    while len(moving):
        waiting = np.where(done[moving] | (found[moving] < 0), np.inf, near[moving])
        chosen = np.argsort(waiting, axis=1)[:, :EXPANDED]
        at = np.arange(len(moving))[:, None]
        open_ = np.isfinite(waiting[at, chosen])
        done[moving[:, None], chosen] = True
        reached = np.where(open_[:, :, None], edges[found[moving[:, None], chosen]], -1).reshape(len(moving), -1)
        # each new point once a target
        reached = np.sort(reached, axis=1)
        new = ~seen[moving[:, None], reached]
        new[:, 1:] &= reached[:, 1:] != reached[:, :-1]
        seen[moving[:, None], reached] = True
        distance = np.full(reached.shape, np.inf, np.float32)
        r, c = np.nonzero(new)
        distance[r, c] = 2.0 - 2.0 * np.einsum("ij,ij->i", points[reached[r, c]], targets[moving[r]])
        all_near = np.concatenate((near[moving], distance), axis=1)
        all_found = np.concatenate((found[moving], np.where(new, reached, -1)), axis=1)
        all_done = np.concatenate((done[moving], np.zeros(reached.shape, bool)), axis=1)
        order = np.argsort(all_near, axis=1, kind="stable")[:, :beam]
        near[moving], found[moving], done[moving] = all_near[at, order], all_found[at, order], all_done[at, order]
        moving = moving[(~done[moving] & np.isfinite(near[moving])).any(axis=1)]
    return found, near


class Graph:
    """A robust-pruned graph of points of length 1; place 0 comes first and is where searches start."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.edges = np.full((len(points), EDGES), -1, np.int32)
        first = min(len(points), FIRST_POINTS)
        for a in range(0, first, IN_STEP):
            places = np.arange(a, min(first, a + IN_STEP))
            near = 2.0 - 2.0 * (points[places] @ points[:first].T)
            near[np.arange(len(places)), places] = np.inf
            found = np.argsort(near, axis=1)[:, :BUILD_BEAM]
            self.edges[places] = robust_prune(points, found, np.take_along_axis(near, found, 1))
        for a in range(0, first, IN_STEP):
            self._mirror(np.arange(a, min(first, a + IN_STEP)))
        size = first
        while size < len(points):
            # a batch doesn't see itself, so it stays a small part of the graph
            batch = np.arange(size, min(len(points), size + max(IN_STEP // 2, size // 16)))
            for a in range(0, len(batch), IN_STEP):
                places = batch[a : a + IN_STEP]
                found, near = beam_search(points[:size], self.edges[:size], 0, points[places], BUILD_BEAM)
                self.edges[places] = robust_prune(points, np.maximum(found, 0), np.where(found < 0, np.inf, near))
            for a in range(0, len(batch), IN_STEP):
                self._mirror(batch[a : a + IN_STEP])
            size += len(batch)

    def _mirror(self, places: np.ndarray) -> None:
        """Edges back to ``places`` from those they lead to; points that get too many are pruned."""
        owner, to = np.repeat(places, EDGES), self.edges[places].ravel().astype(np.int64)
        owner, to = owner[to >= 0], to[to >= 0]
        known = (self.edges[to] == owner[:, None]).any(axis=1)
        owner, to = owner[~known], to[~known]
        order = np.argsort(to, kind="stable")
        owner, to = owner[order], to[order]
        targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
        nth = np.arange(len(to)) - np.repeat(starts, counts)
        held = (self.edges[targets] >= 0).sum(axis=1)
        fits = held + counts <= EDGES
        easy = np.repeat(fits, counts)
        self.edges[to[easy], np.repeat(held, counts)[easy] + nth[easy]] = owner[easy]
        crowded = np.flatnonzero(~fits)
        for a in range(0, len(crowded), IN_STEP):
            part = crowded[a : a + IN_STEP]
            width = int(counts[part].max())
            found = np.full((len(part), EDGES + width), -1, np.int64)
            found[:, :EDGES] = self.edges[targets[part]]
            for row, t in enumerate(part):
                found[row, EDGES : EDGES + counts[t]] = owner[starts[t] : starts[t] + counts[t]]
            self._prune(targets[part], found)

    def _prune(self, places: np.ndarray, found: np.ndarray) -> None:
        near = 2.0 - 2.0 * np.einsum("ij,ikj->ik", self.points[places], self.points[np.maximum(found, 0)])
        near[found < 0] = np.inf
        if found.shape[1] > 4 * EDGES:  # proposals beyond that are far from a crowded point
            order = np.argsort(near, axis=1)[:, : 4 * EDGES]
            found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        self.edges[places] = robust_prune(self.points, np.maximum(found, 0), near)

    def search(self, targets: np.ndarray, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Places (targets, beam) of the points found, -1 behind the last."""
        return beam_search(self.points, self.edges, 0, targets, min(beam, len(self.points)))[0]


def inner_products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last."""
    out = np.zeros(len(values))
    for j in range(values.shape[1]):
        out += values[:, j] * query[j]
    return out


def _padded(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of equal length, shorter ones filled up with zeros."""
    ends = column.offsets.to_numpy()
    sizes, flat = np.diff(ends), column.values.to_numpy()
    out = np.zeros((len(column), dims))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return out


def lengths(values: np.ndarray) -> np.ndarray:
    most = np.abs(values).max(axis=1)
    return most * np.sqrt(((values / most[:, None]) ** 2).sum(axis=1))


def length_bands(values: np.ndarray) -> np.ndarray:
    """Numbers of bands, in each of which lengths differ by a factor of BAND at most."""
    return np.floor(np.log(lengths(values)) / np.log(BAND) + 0.5).astype(np.int64)  # length 1 is the middle of a band


class Shard:
    """A shard's distinct vectors with their ids in order, and the graphs over them, one a band of lengths."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.values, owner = np.unique(values + 0.0, axis=0, return_inverse=True)  # -0.0 equals 0.0
        mixed = np.random.default_rng(0).permutation(len(self.values))
        self.values = self.values[mixed]
        back = np.empty(len(mixed), np.int64)
        back[mixed] = np.arange(len(mixed))
        pairs = np.unique(np.stack((back[owner.ravel()], ids), axis=1), axis=0)  # a repeated row counts once
        self.ids = pairs[:, 1]
        self.ends = np.searchsorted(pairs[:, 0], np.arange(len(mixed) + 1))
        bands, long = length_bands(self.values), lengths(self.values)
        self.graphs = [(places := np.flatnonzero(bands == b), Graph(lifted(self.values[places])), long[places].max()) for b in np.unique(bands)[::-1]]

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of each query's k best ids but its own; a band is searched if it is long enough to hold one."""
        long = lengths(queries)
        targets = np.zeros((len(queries), queries.shape[1] + 1), np.float32)
        targets[:, :-1] = queries / long[:, None]
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        least = np.full(len(queries), -np.inf)
        for places, graph, longest in self.graphs:
            on = np.flatnonzero(~(long * longest * (1 + 1e-9) < least))
            if not len(on):
                continue
            for q, found in zip(on.tolist(), graph.search(targets[on]), strict=True):
                found = places[found[found >= 0]]
                scores = np.repeat(inner_products(self.values[found], queries[q]), self.ends[found + 1] - self.ends[found])
                ids = np.concatenate([self.ids[self.ends[p] : self.ends[p + 1]] for p in found])
                scores, ids = np.append(best[q][1], scores[ids != query_ids[q]]), np.append(best[q][0], ids[ids != query_ids[q]])
                order = np.lexsort((ids, -scores))[:k]
                best[q] = ids[order], scores[order]
                if len(order) == k:
                    least[q] = scores[order[-1]]
        for query_id, (ids, scores) in zip(query_ids.tolist(), best, strict=True):
            yield query_id, ids, scores


def _search(dims: int, k: int):
    """Rows (query_id, vec_id, score) from (shard, is_query, vec_id, embedding), sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, values, shard = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
            vec, rows = batch.column(2).to_numpy(), _padded(batch.column(3), dims)
            found = []
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys, axis=0).any(axis=1)) + 1):
                if not len(part):
                    continue
                if keys[part[0], 0] != current:
                    current, ids, values, shard = keys[part[0], 0], [], [], None
                if not keys[part[0], 1]:
                    ids.append(vec[part])
                    values.append(rows[part])
                elif ids:
                    shard = shard or Shard(np.concatenate(ids), np.concatenate(values))
                    for a in range(0, len(part), IN_STEP):
                        found += shard.top(vec[part[a : a + IN_STEP]], rows[part[a : a + IN_STEP]], k)
            if found:
                owner = np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    return run


def few_copies(vectors: DataFrame, most: int) -> DataFrame:
    """``vectors`` with the ``most`` smallest ids of every vector: no search for fewer neighbours returns others."""
    name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    named = vectors.select("*", *name)
    many = measured(named.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("h1", "h2"))
    place = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = named.join(many, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2", "vec_id"]).withColumn("n", F.row_number().over(place)).where(F.col("n") <= most)
    return named.join(many, ["h1", "h2"], "left_anti").select(*vectors.columns).unionByName(kept.select(*vectors.columns))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among all other vectors, by inner product.

    ``vectors`` and ``queries`` hold (vec_id, embedding) as from ``usable``. A query's own row is the one of
    its vec_id. All vectors are indexed; scores are inner products of the given vectors in double precision.

    Defined cases: ties go to the smaller vec_id; a shorter vector counts as filled up with zeros; copies
    of a vector under several ids are candidates each, a row repeated with its id counts once; a vec_id
    with several vectors is a candidate with each and as a query only with its smallest; with fewer than k
    candidates all are returned; no vectors or no queries give no rows.
    """
    vectors = cut_lineage(few_copies(vectors, k + 1))  # k others and the query's own
    stats = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    rows, dims = stats["n"], max(1, stats["dims"] or 0)
    points = max(LEAST_POINTS, min(SHARD_POINTS, SHARD_BYTES // (12 * dims + 8 * EDGES)))
    shards = max(1, -(-rows // points), min(SHARDS, rows // LEAST_POINTS))
    indexed = vectors.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "vec_id", "embedding")
    wanted = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "embedding")
    dealt = indexed.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "is_query", "vec_id")
    local = dealt.mapInArrow(_search(dims, k), "query_id bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
