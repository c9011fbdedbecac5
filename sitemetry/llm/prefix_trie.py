"""Prefix trie of conversations: one double-array trie for each prefix shard, shared upper nodes merged globally.

A conversation is the sequence of its turns, a node a distinct sequence of first turns. Turns are
named by two 64-bit hashes of role and text, so texts are read once and never shuffled.

A prefix that more than a bounded share of all turns' prefixes equals is hot: fewer than HOT_KEYS
prefixes are, and every prefix of a hot one is hot. A conversation goes to the shard of its first
prefix that isn't hot, so the nodes below belong to one shard alone. Conversations that are hot as a
whole are dealt out by blocks of ids. A task packs the tries of its shards into one pair of arrays:
the child of node ``s`` by the turn with the dense id ``c`` is node ``t = BASE[s] + c`` if and only if
``CHECK[t] == s``. Conversations are walked through the arrays, level by level; nodes of one
shard are finished there, and hot nodes, of which every shard knows a part, are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import HOT_KEYS, cut_lineage

#: A prefix is hot beyond this many conversations, and beyond 1/HOT_KEYS of all turns: so fewer than HOT_KEYS are.
HOT_CONVERSATIONS = 64
#: Turns a task holds at a time, about; conversations of neighbouring ids that stay together where their prefix is hot.
SHARD_TURNS, ID_BLOCK = 262_144, 8_192
#: Words of a turn's text.
WORD = r"[^\x20\x09-\x0D]+"
#: Turns that a rebuilt conversation takes from the first one of its block of ids: crc32(id) modulo HEADS.
HEADS, BLOCK = 4, 20

_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, k1, k2, words): a conversation's turns named by two hashes; ``place`` orders them."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.col("turn").cast("bigint")
    place = F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), role.alias("role"), F.md5(text).alias("digest"))
    rows = conversations.where("conv_id is not null")
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), place.alias("place"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.regexp_count(text, F.lit(WORD)).alias("words")
    )


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, words): each conversation's turns in order, as arrays of one length."""
    told = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "k1", "k2", "words"))).alias("t"))
    return told.select("conv_id", *[F.col(f"t.{c}").alias(c) for c in ("k1", "k2", "words")])


def rebuilt(turns: DataFrame) -> DataFrame:
    """``sequences`` in which every conversation starts with turns of the first one of its block of twenty ids.

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20, all of them if
    there are fewer, none if there is no such conversation; its own turns after its first h follow.
    Rows are dealt by block once, for both sides of the join.
    """
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    told = turns.withColumn("block", block).repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "k1", "k2", "words"))).alias("t"))
    own = told.select("block", "conv_id", F.transform("t", lambda t: t.dropFields("place")).alias("t"))
    heads = own.where("conv_id = block").select("block", F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    rest = F.slice("t", h + 1, F.greatest(F.lit(0), F.size("t") - h))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<struct<k1:bigint,k2:bigint,words:int>>"))
    joined = own.join(heads, "block", "left").select("conv_id", F.concat(head, rest).alias("t"))
    return joined.select("conv_id", *[F.col(f"t.{c}").alias(c) for c in ("k1", "k2", "words")])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero and values of a list column."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.to_numpy()[ends[0] : ends[-1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_names(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of every prefix: the sum of its turns' hashes, each mixed with its depth."""
    sizes = np.diff(offsets)
    depth = np.arange(len(keys), dtype=np.uint64) - np.repeat(offsets[:-1], sizes).astype(np.uint64)
    total = np.cumsum(_mixed(keys.astype(np.int64).view(np.uint64) + _mixed(depth + np.uint64(1))), dtype=np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), total))[offsets[:-1]]
    return (total - np.repeat(before, sizes)).view(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, n) of (conv_id, k1, k2, words), counted by batch."""
    for batch in batches:
        offsets, keys = _lists(batch.column(1))
        names, n = np.unique(prefix_names(keys, offsets), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["prefix", "n"])


_SHARDED = "shard bigint, hot int, conv_id bigint, k1 array<bigint>, k2 array<bigint>, words array<int>"


def _sharded(hot, id_block: int):
    """Rows _SHARDED of (conv_id, k1, k2, words); ``hot``: a broadcast sorted array of hot prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            offsets, keys = _lists(batch.column(1))
            names = prefix_names(keys, offsets)
            cold = np.flatnonzero(~np.isin(names, hot.value))
            first = np.searchsorted(cold, offsets[:-1])
            at = np.append(cold, len(keys))[first]
            whole = at >= offsets[1:]
            depth = np.where(whole, offsets[1:], at) - offsets[:-1]
            shard = np.where(whole, np.floor_divide(ids, id_block), np.append(names, 0)[np.minimum(at, len(keys))])
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(depth.astype(np.int32)), *batch.columns], names=[c.split()[0] for c in _SHARDED.split(", ")])

    return run


class DoubleArray:
    """A trie packed into BASE and CHECK; node 0 is the root. Nodes are added level by level."""

    def __init__(self, alphabet: int):
        self.alphabet, self.floor, self.end = alphabet, 1, 1
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        size = 2 * n + 1024
        while True:
            self._room(self.floor + size)
            free = np.flatnonzero(self.check[self.floor : self.floor + size] < 0)
            if len(free) >= n:
                return free[:n] + self.floor
            size *= 2

    def _taken(self, slots: np.ndarray) -> None:
        self.end = max(self.end, int(slots.max()) + 1)
        after = self._free(1)[0]
        self.floor = int(after)

    def add_level(self, parents: np.ndarray, turns: np.ndarray) -> None:
        """Children of nodes by turn; pairs are distinct and sorted by parent, then turn."""
        if not len(parents):
            return
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(np.append(starts, len(parents)))
        for a, k in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
            self._add_family(int(parents[a]), turns[a : a + k])
        only = starts[sizes == 1]
        if len(only):
            slots = self._free(len(only))
            self.base[parents[only]] = slots - turns[only]
            self.check[slots] = parents[only]
            self._taken(slots)

    def _add_family(self, parent: int, turns: np.ndarray) -> None:
        """First fit among a bounded number of free slots for the first child, else behind all slots in use."""
        shape = turns - turns[0]
        tries = self._free(max(1, min(256, 65_536 // len(turns))))
        self._room(int(max(tries[-1], self.end) + shape[-1] + 1))
        fits = (self.check[tries[:, None] + shape] < 0).all(axis=1)
        first = int(tries[np.argmax(fits)]) if fits.any() else self.end
        self.base[parent] = first - turns[0]
        self.check[first + shape] = parent
        self._taken(first + shape)

    def step(self, nodes: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """The children of nodes by turns, -1 where there is none."""
        at = self.base[nodes] + turns
        fits = (at > 0) & (at < len(self.check)) & (turns < self.alphabet)
        at = np.where(fits, at, 0)
        return np.where(fits & (self.check[at] == nodes), at, -1)


_NODES = "kind int, depth bigint, p1 bigint, p2 bigint, above1 bigint, above2 bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, block bigint, ends string"
#: Nodes of one shard, parts of hot nodes, ids that end at hot nodes.
_OWN, _PART, _ENDS = 0, 1, 2


def _record(kind: int, n: int, **columns) -> pa.RecordBatch:
    fields = [c.split() for c in _NODES.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[t]) if name in columns else pa.nulls(n, kinds[t]) for name, t in fields], names=[f[0] for f in fields])


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def trie_nodes(ids: np.ndarray, hot: np.ndarray, offsets: np.ndarray, k1: np.ndarray, k2: np.ndarray, words: np.ndarray, id_block: int) -> Iterator[pa.RecordBatch]:
    """Rows _NODES of a task's conversations, by a double-array trie over its dense turn ids."""
    order = np.argsort(ids, kind="stable")
    sizes, starts = np.diff(offsets)[order], offsets[:-1][order]
    ids, hot = ids[order], hot[order]
    names = [prefix_names(k, offsets) for k in (k1, k2)]
    # dense turn ids
    by_key = np.lexsort((k2, k1))
    new = np.ones(len(k1), bool)
    new[1:] = (np.diff(k1[by_key]) != 0) | (np.diff(k2[by_key]) != 0)
    dense = np.empty(len(k1), np.int64)
    dense[by_key] = np.cumsum(new) - 1
    alphabet = int(new.sum()) or 1

    trie, node = DoubleArray(alphabet), np.zeros(len(ids), np.int64)
    levels = [np.zeros(1, np.int64)]
    for depth in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > depth)
        turns = dense[starts[on] + depth]
        pairs = np.unique(node[on] * alphabet + turns)
        parents = pairs // alphabet
        trie.add_level(parents, pairs - parents * alphabet)
        node[on] = trie.step(node[on], turns)
        levels.append(trie.step(parents, pairs - parents * alphabet))

    # A second walk, over the finished arrays, gathers what the nodes' members add up to.
    slots = trie.end
    n_convs, first = np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    weight, is_hot, place = np.zeros(slots, np.int64), np.zeros(slots, bool), np.full(slots, -1, np.int64)
    node = np.zeros(len(ids), np.int64)
    n_convs[0], first[0], is_hot[0] = len(ids), ids[0], True
    for depth in range(len(levels) - 1):
        on = np.flatnonzero(sizes > depth)
        at = starts[on] + depth
        node[on] = to = trie.step(node[on], dense[at])
        back = slice(None, None, -1)  # ids ascend, so the first member is written last
        first[to[back]], weight[to[back]], place[to[back]], is_hot[to[back]] = ids[on][back], words[at][back], at[back], (depth < hot[on])[back]
        np.add.at(n_convs, to, 1)

    n_children, n_leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for at in reversed(levels[1:]):
        own = at[~is_hot[at]]  # hot nodes have what their own children have left here
        n_leaves[own] += n_children[own] == 0
        saved[own] += (n_convs[own] - 1) * weight[own]
        up = trie.check[own]
        np.add.at(n_children, up, 1)
        np.add.at(n_leaves, up, n_leaves[own])
        np.add.at(saved, up, saved[own])

    depths = np.zeros(slots, np.int64)
    for depth, at in enumerate(levels):
        depths[at] = depth
    all_nodes = np.concatenate(levels)
    name = [np.append(x, 0)[place] for x in names]  # the root's place is -1: its name is 0
    above = trie.check[all_nodes]
    above_name = [x[above] for x in name]

    by_end = np.lexsort((ids, node))
    ends, cuts = node[by_end], np.flatnonzero(np.diff(node[by_end], prepend=-1))
    digests = np.full(slots, _EMPTY, object)
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(ends)), strict=True):
        at, members = int(ends[a]), ids[by_end[a:b]]
        if not is_hot[at]:
            digests[at] = hashlib.sha256(_joined(members).encode()).hexdigest()
            continue
        block = np.floor_divide(members, id_block)
        for part in np.split(members, np.flatnonzero(np.diff(block)) + 1):
            rows.append((depths[at], name[0][at], name[1][at], part[0] // id_block, _joined(part)))
    if rows:
        d, a, b, block, joined = zip(*rows, strict=True)
        yield _record(_ENDS, len(rows), depth=d, p1=a, p2=b, block=block, ends=joined)
    for kind, chosen in ((_OWN, ~is_hot[all_nodes]), (_PART, is_hot[all_nodes])):
        at, up = all_nodes[chosen], above[chosen]
        told = {"depth": depths[at], "p1": name[0][at], "p2": name[1][at], "above1": above_name[0][chosen], "above2": above_name[1][chosen], "conv_id": first[at], "n_convs": n_convs[at], "n_children": n_children[at], "n_leaves": n_leaves[at], "saved_tokens": saved[at], "words": weight[at]}
        if kind == _OWN:
            told |= {"parent_conv_id": pa.array(first[up], mask=is_hot[up]), "ends": digests[at].tolist()}
        yield _record(kind, len(at), **told)


def _packed(id_block: int):
    """``trie_nodes`` of a whole partition of rows _SHARDED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hot, sizes, lists = [], [], [], [[], [], []]
        for batch in batches:
            ids.append(batch.column(2).to_numpy())
            hot.append(batch.column(1).to_numpy())
            for k in range(3):
                offsets, values = _lists(batch.column(3 + k))
                lists[k].append(values)
            sizes.append(np.diff(offsets))
        if sum(map(len, ids)):
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            yield from trie_nodes(np.concatenate(ids), np.concatenate(hot), offsets, *[np.concatenate(x).astype(np.int64) for x in lists], id_block)

    return run


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, p1, p2, ends_sha256) of sorted (depth, p1, p2, block, ends): a digest is taken part by part."""
    current, digest = None, None
    for batch in batches:
        done = []
        for *key, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if key != current:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "p1", "p2", "ends_sha256"), x, strict=True)) for x in done])
    if current is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "p1", "p2", "ends_sha256"), (*current, digest.hexdigest()), strict=True))])


_UPPER = "depth bigint, p1 bigint, p2 bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows _UPPER of the merged hot nodes, fewer than HOT_KEYS and the root: children before parents."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    known = {(r["depth"], r["p1"], r["p2"]): r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        up = known.get((r["depth"] - 1, r["above1"], r["above2"])) if r["depth"] else None
        r["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            for name, more in (("n_children", 1), ("n_leaves", r["n_leaves"]), ("saved_tokens", r["saved_tokens"])):
                up[name] += more
    fields = [c.split()[0] for c in _UPPER.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], pa.int64()) for f in fields], names=fields)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``paths`` is what ``sequences`` or ``rebuilt`` returns. ``conv_id`` is the smallest member of a node,
    ``saved_tokens`` the words that a cache of shared prefixes saves in its subtree, ``ends_sha256`` the
    digest of the comma-joined ids that end there.

    Defined cases: rows without a conv_id belong to no conversation; turns of one number are ordered by
    role, then by the MD5 of their text, and repeated rows are repeated turns; turnless conversations
    end at the root; no conversations give no nodes. A conversation's turns (20 bytes each) form one
    row. The ids that end at a hot node are joined block by block where they are, and its digest,
    sequential by nature, streams over the blocks in one task of bounded memory.
    """
    spark = paths.sparkSession
    paths = cut_lineage(paths)
    total = paths.agg(F.sum(F.size("k1")).alias("turns"), F.count(F.lit(1)).alias("n")).first()
    bound = max(HOT_CONVERSATIONS, (total["turns"] or 0) // HOT_KEYS)
    counted = paths.mapInArrow(_prefixes, "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in counted.where(F.col("n") > bound).select("prefix").collect()], np.int64)))  # fewer than HOT_KEYS

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["turns"] or 0) // SHARD_TURNS))
    dealt = paths.mapInArrow(_sharded(hot, ID_BLOCK), _SHARDED).repartition(tasks, F.xxhash64("shard"))
    nodes = cut_lineage(dealt.mapInArrow(_packed(ID_BLOCK), _NODES))

    key = ["depth", "p1", "p2"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where(F.col("kind") == _PART).groupBy(*key, "above1", "above2").agg(F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *sums)
    upper = cut_lineage(parts.repartition(1).mapInArrow(_finished, _UPPER))
    ends = nodes.where(F.col("kind") == _ENDS).select(*key, "block", "ends").repartition(*key).sortWithinPartitions(*key, "block")
    digests = ends.mapInArrow(_ends_digests, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")

    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = nodes.where(F.col("kind") == _OWN).withColumnRenamed("ends", "ends_sha256")
    above = F.broadcast(upper.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("above1"), F.col("p2").alias("above2"), F.col("conv_id").alias("above_conv")))  # fewer than HOT_KEYS and the root
    below = own.join(above, ["depth", "above1", "above2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_conv"))
    finished = upper.join(digests, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return below.select(*shown).unionByName(finished.select(*shown))
