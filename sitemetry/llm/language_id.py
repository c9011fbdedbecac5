"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW``, once forwards and once backwards, with
gated recurrent units of ``HIDDEN`` cells; their states at a position give the probabilities of
the languages at that position, and a document's probabilities are the mean over all its
positions. It is trained here, in numpy, by backpropagation through time on windows from a
bounded sample of labelled documents. Gates and states use clipped linear units in place of
sigmoid and tanh: they cost a fraction of the time and saturate alike.

Inference is one narrow pass: the few thousand weights travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import measured, pieces

HIDDEN, WINDOW = 6, 64
#: The training sample: documents in all, which the languages share evenly, documents of a language, windows of a document.
SAMPLE_DOCS, DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 19_200, 300, 8
STEPS, BATCH, LEARNING_RATE, SEED = 260, 384, 0.02, 5
#: Windows that go through the network together.
LANES = 1024

PAD = 256
UNDETERMINED = "und"
#: Documents stay in the pipeline if one language holds more than this share of their probability.
MAJORITY = 0.5


@dataclass
class Network:
    """Weights: byte tables (2 directions, 257, 3H), gate and state matrices, and the output layer."""

    languages: list[str]
    table: np.ndarray
    gates: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        net = Network(
            languages,
            f(2, PAD + 1, 3 * hidden, scale=0.5),
            f(2, 2 * hidden, hidden, scale=hidden**-0.5),
            f(2, hidden, hidden, scale=hidden**-0.5),
            f(len(languages), 2 * hidden, scale=0.3),
            np.zeros((len(languages), 1), np.float32),
        )
        net.close_pad()
        return net

    def close_pad(self) -> None:
        """A padding byte shuts the update gate, so it leaves the state as it is."""
        hidden = self.state.shape[1]
        self.table[:, PAD, :] = 0
        self.table[:, PAD, :hidden] = -1e4

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.gates, self.state, self.out, self.bias]

    def states(self, windows: np.ndarray, d: int, trace: list | None = None) -> np.ndarray:
        """States (T, H, lanes) of direction d over windows (T, lanes) of byte codes."""
        steps, lanes = windows.shape
        hidden = self.state.shape[1]
        fed = np.ascontiguousarray(self.table[d].take(windows, axis=0).transpose(0, 2, 1))
        h = np.zeros((hidden, lanes), np.float32)
        out = np.empty((steps, hidden, lanes), np.float32)
        gate, cand, held = np.empty((2 * hidden, lanes), np.float32), np.empty((hidden, lanes), np.float32), np.empty((hidden, lanes), np.float32)
        update, reset = gate[:hidden], gate[hidden:]
        for t in range(steps):
            np.matmul(self.gates[d], h, out=gate)
            gate += fed[t, : 2 * hidden]
            np.minimum(gate, 1, out=gate)
            np.maximum(gate, -1, out=gate)
            gate += 1
            gate *= 0.5
            np.multiply(reset, h, out=held)
            np.matmul(self.state[d], held, out=cand)
            cand += fed[t, 2 * hidden :]
            np.minimum(cand, 1, out=cand)
            np.maximum(cand, -1, out=cand)
            if trace is not None:
                trace.append((h.copy(), update.copy(), reset.copy(), cand.copy()))
            cand -= h
            cand *= update
            h = np.add(cand, h, out=out[t])
        return out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Language probabilities (T, languages, lanes) of every position."""
        hidden = self.state.shape[1]
        scores = np.matmul(self.out[:, :hidden], self.states(windows, 0))
        scores += np.matmul(self.out[:, hidden:], self.states(windows[::-1], 1)[::-1])
        scores += self.bias
        scores -= scores.max(axis=1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
        return scores

    def label_positions(self, text: str) -> list[str]:
        """The likeliest language at every byte of a text."""
        windows, _ = cut_windows([text.encode()])
        p = self.probabilities(windows.T)
        best = p.argmax(axis=1).T.ravel()[: len(text.encode())]
        return [self.languages[i] for i in best]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, languages) over all positions of each text."""
        windows, owner = cut_windows(texts)
        pooled = np.zeros((len(texts), len(self.languages)), np.float64)
        for at in range(0, len(windows), LANES):
            lanes = np.ascontiguousarray(windows[at : at + LANES].T)
            p = self.probabilities(lanes)
            p *= (lanes != PAD)[:, None, :]
            np.add.at(pooled, owner[at : at + LANES], p.sum(axis=0).T)
        return pooled / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) of byte codes over whole texts, the last one padded, and their owners."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    windows = np.full((sum(counts), WINDOW), PAD, np.uint16)
    flat, at = windows.reshape(-1), 0
    for text, n in zip(texts, counts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    return windows, np.repeat(np.arange(len(texts)), counts)


def _gradients(net: Network, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
    hidden, steps = net.state.shape[1], windows.shape[0]
    traces: list[list] = [[], []]
    forward = net.states(windows, 0, traces[0])
    backward = net.states(windows[::-1], 1, traces[1])[::-1]
    both = np.concatenate((forward, backward), axis=1)
    scores = np.matmul(net.out, both) + net.bias
    scores -= scores.max(axis=1, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=1, keepdims=True)
    real = windows != PAD
    p[:, labels, np.arange(windows.shape[1])] -= 1
    p *= real[:, None, :] / np.float32(max(1, real.sum()))
    d_table, d_gates, d_state = np.zeros_like(net.table), np.zeros_like(net.gates), np.zeros_like(net.state)
    d_out = np.einsum("tcl,thl->ch", p, both, optimize=True)
    d_bias = p.sum(axis=(0, 2))[:, None]
    d_both = np.matmul(net.out.T, p)
    for d in (0, 1):
        given = d_both[:, :hidden] if d == 0 else d_both[::-1, hidden:]
        seen = windows if d == 0 else windows[::-1]
        d_h = np.zeros_like(given[0])
        d_fed = np.empty((steps, 3 * hidden, windows.shape[1]), np.float32)
        for t in range(steps - 1, -1, -1):
            h, update, reset, cand = traces[d][t]
            d_h = d_h + given[t]
            d_cand = d_h * update * (np.abs(cand) < 1)
            d_update = d_h * (cand - h) * 0.5 * ((update > 0) & (update < 1))
            d_held = net.state[d].T @ d_cand
            d_reset = d_held * h * 0.5 * ((reset > 0) & (reset < 1))
            d_gate = np.concatenate((d_update, d_reset))
            d_gates[d] += d_gate @ h.T
            d_state[d] += d_cand @ (reset * h).T
            d_h = d_h * (1 - update) + d_held * reset + net.gates[d].T @ d_gate
            d_fed[t, : 2 * hidden], d_fed[t, 2 * hidden :] = d_gate, d_cand
        flat = d_fed.transpose(0, 2, 1).reshape(-1, 3 * hidden)
        for k in range(3 * hidden):
            d_table[d, :, k] = np.bincount(seen.ravel(), weights=flat[:, k], minlength=PAD + 1)
    return [d_table, d_gates, d_state, d_out, d_bias]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted with Adam to windows (n, WINDOW) and the index of each one's language."""
    net = Network.fresh(languages, seed=seed)
    r = np.random.default_rng(seed)
    groups = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    for step in range(1, steps + 1):
        # every language fills the same share of a batch
        pick = np.concatenate([r.choice(g, max(1, BATCH // len(groups))) for g in groups])
        rate = LEARNING_RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for i, (part, g) in enumerate(zip(net.parts(), _gradients(net, windows[pick].T, labels[pick]), strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            part -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        net.close_pad()
    return net


def _labelled_windows(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows from a bounded sample of (doc_id, text, lang); a document is in by a hash of its id and text.

    All languages share SAMPLE_DOCS evenly, each with at most DOCS_PER_LANGUAGE documents as expected;
    only the sample's windows of WINDOW characters reach the driver.
    """
    rows = labelled.where("text is not null and lang is not null and text != ''")
    counts = measured(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), 64)
    languages = counts.count()
    if not languages:
        return np.empty((0, WINDOW), np.uint16), np.empty(0, np.int64), []
    wanted = min(DOCS_PER_LANGUAGE, SAMPLE_DOCS / languages)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    room = F.greatest(F.lit(0), F.char_length("text") - WINDOW)
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)), lambda i: F.floor(room * i / F.lit(WINDOWS_PER_DOC - 1)).cast("int"))
    windows = F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(WINDOW))))
    drawn = rows.withColumn("draw", draw).join(counts, "lang").where(F.col("draw") < F.lit(1.2 * wanted * (1 << 40)) / F.col("n"))
    taken = drawn.select("draw", "lang", windows.alias("windows")).orderBy("draw", "lang").limit(int(1.5 * wanted * languages) + 1).collect()
    names = sorted({r["lang"] for r in taken})
    found = [(w.encode()[:WINDOW], names.index(r["lang"])) for r in taken for w in r["windows"] if w]
    cut, _ = cut_windows([w for w, _ in found])
    return cut, np.array([k for _, k in found]), names


def fit(labelled: DataFrame) -> Network | None:
    """A network for the languages of (doc_id, text, lang); None if no row is labelled."""
    windows, labels, languages = _labelled_windows(labelled)
    present = sorted(set(labels.tolist()))
    if not present:
        return None
    order = {k: i for i, k in enumerate(present)}
    return train(windows, np.array([order[k] for k in labels.tolist()]), [languages[k] for k in present])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``, from the whole text alone.

    Defined cases: a null text, one without a letter, or no learned language gives ``und`` with
    score 0; equal probabilities go to the first language by name; repeated rows are each judged;
    a null doc_id is kept; an empty table gives an empty one; other columns are not read.
    """
    return _judged(docs, net).select("doc_id", "lang_pred", "score")


def _judged(docs: DataFrame, net: Network | None) -> DataFrame:
    """``predict`` with the hash of each row's text and whether it has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and net is not None]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                pooled = net.document_probabilities([texts[i].encode() for i in known])
                for i, k, p in zip(known, pooled.argmax(axis=1), pooled.max(axis=1), strict=True):
                    names[i], scores[i] = net.languages[k], min(1.0, float(p))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "text_key": batch.column(1),
                    "lettered": pa.array([t is not None for t in texts], pa.bool_()),
                    "lang_pred": pa.array(names, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                }
            )

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), lettered.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, lettered boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: a third of the ids by CRC-32."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _learned(docs: DataFrame) -> Network | None:
    return fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows that are not held out, judges all."""
    return predict(docs, _learned(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, more_than: float = MAJORITY) -> DataFrame:
    """``docs`` without the rows that no language fits: ``und``, or a score of ``more_than`` or less.

    Defined cases: each row is judged by its own text, whatever other rows share its doc_id; null texts
    and texts without a letter go; repeated rows stay or go together; a null doc_id is an id like any
    other; where no language could be learned, only texts without a letter go; an empty table gives an
    empty one; all columns are kept.
    """
    net = _learned(docs)
    none_fits = ~F.col("lettered")
    if net is not None:
        none_fits = none_fits | F.col("lang_pred").eqNullSafe(UNDETERMINED) | (F.col("score") <= more_than)
    found = _judged(docs, net).where(none_fits).select(F.col("doc_id").alias("__drop"), F.col("text_key").alias("__key")).distinct()
    found = measured(found, 48)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__drop")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(found, same, "left_anti").select(*docs.columns)
