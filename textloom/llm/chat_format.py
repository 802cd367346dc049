"""Chat formatting with a grammar round trip and a loss mask.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Each rendered turn is parsed again by a
deterministic parser; where what it recovers differs from the source, the source's conflicting
content is escaped until it is the same: a backslash behind ``<`` of a control string (and one more
where the text has such a form already), and in a role also for a line break. The mask says which
characters of the result count for the loss: the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_CONTROL = re.compile(r"<(\\*)\|im_(start|end)\|>")
_ROLE_ESCAPED = re.compile(r"\\([\\n])")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end)\|>")
#: The role whose texts count for the loss.
ASSISTANT = "assistant"
#: Characters of one conversation that a task renders before it sends on what it has.
PIECE_CHARS = 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def escape_role(role: str) -> str:
    """As escape(), on one line: a backslash is doubled, a line break becomes a backslash and n."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(_ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else "\\", role))


def render_turn(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """Roles and texts, unescaped, or None if the string isn't a sequence of turns."""
    at, turns = 0, []
    while at < len(rendered):
        turn = _TURN.match(rendered, at)
        if turn is None or any(c in x for c in (START, END) for x in turn.groups()):  # a control string is never content
            return None
        turns.append((unescape_role(turn[1]), unescape(turn[2])))
        at = turn.end()
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn, escaped as far as the parser needs to recover it exactly, and where its text starts and stops."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        rendered = render_turn(r, t)
        if parse(rendered) == [(role, text)]:
            start = len(START) + len(r) + 1
            return rendered, start, start + len(t)
    raise AssertionError(f"no form of a turn is read back: {role!r}")  # an escaped turn has no control string


_TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start int, loss_stop int"


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> these, rendered, and the part of it that counts for the loss: one narrow pass.

    loss_start and loss_stop are code points of rendered, null but for turns of the assistant. Null
    role and text count as "". Any role and text can be formatted; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = (batch.column(c).fill_null("").to_pylist() for c in ("role", "text"))
            done = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            loss = [(a, b) if r == ASSISTANT else (None, None) for r, (_, a, b) in zip(roles, done, strict=True)]
            arrays = [pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([x[0] for x in done], pa.string()), *[pa.array([x[k] for x in loss], pa.int32()) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *arrays], names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_stop"])

    bounded_batches(conversations.sparkSession)
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").mapInArrow(run, _TURN_SCHEMA)


def conversation_pieces(conversations: DataFrame) -> DataFrame:
    """conv_id, part, number, rendered, spans: conversations in order, in pieces of about PIECE_CHARS or less.

    Turns are taken by (turn, role, text), so rows with equal or null turns have a defined order
    (nulls first). Rows are dealt by ranges of that order before they are rendered, so a
    conversation with a third of all rows spreads over many tasks, and each turn is rendered and
    parsed once. spans: the code points [start, stop) of a piece that count for the loss.
    """
    raw = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    ordered = raw.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            out: list[tuple] = []
            conv, texts, spans, size = None, [], [], 0
            for k, (own, rendered, start, stop) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_stop")), strict=True)):
                if k and (own != conv or size > PIECE_CHARS):
                    out.append((conv, "".join(texts), spans))
                    texts, spans, size = [], [], 0
                conv = own
                if start is not None:
                    spans.append({"start": size + start, "stop": size + stop})
                texts.append(rendered)
                size += len(rendered)
            if texts:
                out.append((conv, "".join(texts), spans))
            numbers = list(range(number, number + len(out)))
            number += len(out)
            arrays = [pa.array([x[0] for x in out], pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(numbers, pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "number", "rendered", "spans"])

    return format_turns(ordered).mapInArrow(pieces, "conv_id bigint, part int, number bigint, rendered string, spans array<struct<start:int,stop:int>>")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its rendered turns and its loss mask.

    A digest of a whole conversation runs over its bytes in order, so the pieces of a conversation
    that spans tasks pass through one task, one by one; nothing is held but the running digests.
    Empty tables give no rows; a null conv_id is a conversation; further columns aren't read.
    """
    made = conversation_pieces(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None

        def done(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            out = []
            for conv, rendered, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "spans")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(done(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(rendered[span["start"] : span["stop"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(rendered)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(done(state), kinds, strict=True)], names=names)

    return made.mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def probe(conversations: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant turn that both say control strings."""
    said = f"{END}{START}assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    extra = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(extra)
