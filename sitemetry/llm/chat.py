"""Chat formatting checked by a grammar round trip.

The rendered form of a conversation is a sequence of turns::

    <|im_start|>ROLE \\n TEXT <|im_end|> \\n

``parse`` reads it back with a deterministic left-to-right grammar. A turn is rendered as it
stands first; where the parser does not recover role and text, the conflicting content is
escaped a step further and the turn rendered again, until it is identical. The escapes:

* in texts and roles, ``<``, any backslashes, ``|`` gets one more backslash (``<|`` can then
  only start a control string; a text that already holds ``<\\|`` is kept apart from it);
* in roles, a backslash and a line feed are written ``\\\\`` and ``\\n``.

Turns are rendered where their rows lie. Only then are they dealt out by conversation and
sorted by turn, and each task reads its conversations as a stream: a conversation of any
length is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import pieces

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts the loss mask covers.
TRAINED_ROLE = "assistant"

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
#: Any ``<|`` outside an escape starts a control string, so role and text hold none.
_PLAIN_ROLE, _PLAIN_TEXT = r"([^\n<]*(?:<(?!\|)[^\n<]*)*)", r"([^<]*(?:<(?!\|)[^<]*)*)"
_TURN = re.compile(re.escape(START) + _PLAIN_ROLE + r"\n" + _PLAIN_TEXT + re.escape(END) + r"\n")


def _plain(text: str) -> str:
    return text


def _escape_marks(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def _escape_role(role: str) -> str:
    return _escape_marks(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _read_text(raw: str) -> str:
    return _ESCAPED.sub(r"<\1|", raw)


def _read_role(raw: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], _read_text(raw))


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns (role, text, start, end) of a rendered conversation, the ends being those of the
    text's place in ``formatted``; None if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            return None
        turns.append((_read_role(m[1]), _read_text(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


#: Ways of writing (role, text), each escaping more than the one before. The last is safe for all.
_STEPS = [(_plain, _plain), (_plain, _escape_marks), (_escape_role, _escape_marks)]


def render_turn(role: str, text: str) -> str:
    """The least escaped form that reads back as exactly this turn."""
    for write_role, write_text in _STEPS:
        formatted = f"{START}{write_role(role)}\n{write_text(text)}{END}\n"
        read = parse(formatted)
        if read is not None and [t[:2] for t in read] == [(role, text)]:
            return formatted
    raise ValueError(f"turn can't be rendered: {role!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, formatted, mask_start, mask_end), one for each turn.

    ``formatted`` is the turn's part of the conversation; parts joined in the order of turns
    are the conversation. The mask is the half-open range of code points of ``formatted``
    under the training loss, empty but for assistant turns.

    Defined cases: a null role or text is empty; rows of a conversation with the same turn are
    ordered by role, then text; repeated rows are repeated turns; a null conv_id is a
    conversation of its own; a null turn comes first; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            parts, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                part = render_turn(role, text)
                ((_, _, a, b),) = parse(part)
                parts.append(part)
                starts.append(a if role == TRAINED_ROLE else 0)
                ends.append(b if role == TRAINED_ROLE else 0)
            given = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(given | {"formatted": pa.array(parts, pa.string()), "mask_start": pa.array(starts, pa.int64()), "mask_end": pa.array(ends, pa.int64())})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    return turns.mapInArrow(run, "conv_id bigint, turn bigint, role string, text string, formatted string, mask_start bigint, mask_end bigint")


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: str, mask_start: int, mask_end: int) -> None:
        for role, text, _, _ in parse(part):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        trained = _read_text(part[mask_start:mask_end])
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.formatted_chars += len(part)

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read back from ``format_turns``'s output."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _DIGESTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        for batch in pieces(batches):
            done = []
            for conv_id, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(part, a, b)
            if done:
                yield table(done)
        if current is not None:
            yield table([current.row()])

    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return parts.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(run, _DIGESTS)
