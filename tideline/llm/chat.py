"""Chat conversations as text for training, with a grammar that reads them back.

    conversation = turn*
    turn         = "<|im_start|>" role LF body "<|im_end|>" LF

A body holds no control string, a role no line feed. A turn is first rendered as it is and read
back by the parser; if that does not give the same role and text, its conflicting content is
escaped and it is tried again, until it does. Turns end where the grammar says they do, whatever
follows, so that a conversation reads back if all of its turns do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tideline.llm.batches import prepare, quoted, slices

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def escape(text: str) -> str:
    r"""Put a backslash into every ``<|``, and one more where there are some: ``<\|``, ``<\\|``."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


class Parser:
    """Turns of a conversation from pieces of its text, however it is cut."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn that is complete; ``ValueError`` where the grammar is broken."""
        self.rest += piece
        while True:
            end = self.rest.find(END, len(START))
            if end < 0 or len(self.rest) <= end + len(END):
                return
            head, line, body = self.rest[:end].partition("\n")
            if not head.startswith(START) or not line or START in body or self.rest[end + len(END)] != "\n":
                raise ValueError("no turn")
            self.rest = self.rest[end + len(END) + 1:]
            role = re.sub(r"\\.", lambda m: _ROLE_BACK.get(m[0], m[0]), head[len(START):])
            yield role, unescape(body)

    def close(self) -> None:
        if self.rest:
            raise ValueError("text after the last turn")


def reads_back(piece: str, role: str, text: str) -> bool:
    try:
        parser = Parser()
        turns = list(parser.feed(piece))
        parser.close()
    except ValueError:
        return False
    return turns == [(role, text)]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its body begins and ends in it."""
    for safe_role in (role, "".join(_ROLE.get(c, c) for c in role)):
        for body in (text, escape(text)):
            head = f"{START}{safe_role}\n"
            piece = f"{head}{body}{END}\n"
            if reads_back(piece, role, text):
                return piece, len(head), len(head) + len(body)
    raise ValueError("a turn does not read back")


FORMATTED = StructType([
    StructField("conv_id", LongType()), StructField("position", LongType()), StructField("start", LongType()),
    StructField("piece", StringType()), StructField("learned", BooleanType()),
    StructField("loss_start", LongType()), StructField("loss_end", LongType())])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, position, start = object(), 0, 0
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index("text")):
            rows = []
            for r in part.select(["conv_id", "role", "text"]).to_pylist():
                if r["conv_id"] != now:
                    now, position, start = r["conv_id"], 0, 0
                piece, a, b = render(r["role"], r["text"])
                learned = r["role"] == LEARNED
                rows.append((now, position, start, piece, learned,
                             start + a if learned else None, start + b if learned else None))
                position, start = position + 1, start + len(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
                names=FORMATTED.names)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted text of all conversations, a row for each turn (``conv_id turn role text``).

    Gives ``conv_id``; ``position`` of the turn; ``start``, where its ``piece`` begins in the text
    of the conversation, which is the pieces joined in order; ``learned``, whether it is under the
    loss mask; and ``loss_start`` and ``loss_end``, the code points of that text under the mask
    (null elsewhere). Turns are ordered by ``turn``, then role and text; a null turn comes first.

    Null roles and texts are empty, null ids make one conversation, repeated rows are repeated
    turns, other columns are left out. A task reads the turns of a conversation one after the
    other and never holds more than a slice of them, however long it is.
    """
    prepare(conversations.sparkSession)
    turns = conversations.select(
        F.col(quoted("conv_id")).cast("long").alias("conv_id"), F.col(quoted("turn")).alias("turn"),
        F.coalesce(F.col(quoted("role")), F.lit("")).alias("role"),
        F.coalesce(F.col(quoted("text")), F.lit("")).alias("text"))
    dealt = turns.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, FORMATTED)


READ = StructType([
    StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
    StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
    StructField("formatted_chars", LongType())])


class _Reader:
    """What is recovered from one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parser = conv_id, Parser()
        self.turns = self.learned = self.chars = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, start: int, piece: str, a: int | None, b: int | None) -> None:
        if start != self.chars:
            raise ValueError("a piece is missing")
        self.chars += len(piece)
        for role, text in self.parser.feed(piece):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        if a is not None:
            text = unescape(piece[a - start:b - start])
            self.learned += len(text)
            self.loss_hash.update(text.encode())

    def row(self) -> tuple:
        self.parser.close()
        return (self.conv_id, self.turns, self.turns_hash.hexdigest(), self.learned,
                self.loss_hash.hexdigest(), self.chars)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*done), (
                pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=READ.names)

    reader, done = None, []
    for batch in batches:
        for r in batch.select(["conv_id", "start", "piece", "loss_start", "loss_end"]).to_pylist():
            if reader is None or r["conv_id"] != reader.conv_id:
                if reader:
                    done.append(reader.row())
                reader = _Reader(r["conv_id"])
            reader.add(r["start"], r["piece"], r["loss_start"], r["loss_end"])
        if done:
            yield rows(done)
            done = []
    if reader:
        yield rows([reader.row()])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """What the formatted text of each conversation says when it is parsed.

    ``n_turns``; ``turns_sha256`` over role, line feed, text, line feed of every turn;
    ``loss_chars`` and ``loss_sha256`` of all text under the loss mask, unescaped; and
    ``formatted_chars``. A conversation that breaks the grammar or lacks a piece is an error.
    """
    prepare(formatted.sparkSession)
    dealt = formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(_read, READ)
