"""Chat formatting: an event log is folded into messages, and those are rendered.

Events carry ``conv_id``, ``turn``, ``message``, ``seq``, ``kind``, ``role``, ``text``.
A message is told by conversation, turn and ``message``. By ascending ``seq``, a
``delta`` appends its text, an ``edit`` replaces what there is, and a ``regenerate``
clears it and appends its own. The role is that of the last event that names
one. An event of an unknown kind counts as a delta. Null texts are empty.

Messages are folded each on its own, so a conversation that holds a third of
the log is dealt to all tasks; only reading a conversation back is in order, as
a stream of its pieces with constant memory.

A piece is the rendered text of one message. The text of a conversation is its
pieces in the order of turn, role, text. Control strings begin with ``<`` or
``[``; inside roles and texts these are written ``\\1`` and ``\\2``, a line feed in a role
``\\3``, and a backslash ``\\0``, so no text can look like a mark and all come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
DELTA_CHARS = 512
LEARNED = "assistant"
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))


def escaped(text: Column, more: tuple[tuple[str, str], ...] = ()) -> Column:
    for raw, code in (*_ESCAPES, *more):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: str) -> str:
    """The text before escaping; every backslash opens a code of two characters."""
    for raw, code in reversed((*_ESCAPES, ("\n", "\\3"))):
        text = text.replace(code, raw)
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, message, role, text.

    Ties in ``seq`` are ordered by kind, then text. A message without a role has
    an empty one. An empty log gives no messages.
    """
    parts = F.sort_array(
        F.collect_list(
            F.struct(
                "seq",
                F.coalesce("kind", F.lit("delta")).alias("kind"),
                F.coalesce("text", F.lit("")).alias("text"),
                "role",
            )
        )
    )
    grouped = events.groupBy("conv_id", "turn", "message").agg(parts.alias("parts"))
    start = F.struct(F.lit("").alias("role"), F.lit("").alias("text"))

    def step(state: Column, part: Column) -> Column:
        replaces = part["kind"].isin("edit", "regenerate")
        text = F.when(replaces, part["text"]).otherwise(F.concat(state["text"], part["text"]))
        return F.struct(
            F.coalesce(part["role"], state["role"]).alias("role"), text.alias("text")
        )

    folded = grouped.withColumn("final", F.aggregate("parts", start, step))
    return folded.select("conv_id", "turn", "message", "final.role", "final.text")


def render(messages: DataFrame) -> DataFrame:
    """One piece per message, with the span of what is to be learned in it.

    ``piece`` is the rendered text; ``loss_start`` and ``loss_length`` count its code
    points under the loss mask, which holds the texts of assistants alone.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), (("\n", "\\3"),)), F.lit("\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    return messages.select(
        "conv_id",
        "turn",
        "message",
        "role",
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.length(head).cast("bigint").alias("loss_start"),
        F.when(learned, F.length(body)).otherwise(0).cast("bigint").alias("loss_length"),
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its rendered pieces and loss spans."""
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,"
        " loss_sha256 string, formatted_chars bigint"
    )
    arrow = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, piece, start, length in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if state is None or state.conv != conv:
                    if state is not None:
                        done.append(state.row())
                    state = _Reader(conv)
                state.read(piece, start, length)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row()], schema=arrow)

    return (
        pieces.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "piece", "message")
        .select(F.col("conv_id").cast("bigint"), "piece", "loss_start", "loss_length")
        .mapInArrow(digest, schema)
    )


class _Reader:
    """Parses the pieces of one conversation, keeping digests only."""

    def __init__(self, conv):
        self.conv = conv
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def read(self, piece: str, start: int, length: int) -> None:
        if not (piece.startswith(OPEN) and piece.endswith(CLOSE)):
            raise ValueError("a piece without its marks")
        role, text = piece[len(OPEN) : -len(CLOSE)].split("\n", 1)
        self.turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
        learned = unescaped(piece[start : start + length])
        self.loss.update(learned.encode())
        self.loss_chars += len(learned)
        self.chars += len(piece)
        self.n += 1

    def row(self) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
        }


def as_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns as the log that streaming would have left.

    Each row is a message of its own, also where rows repeat. Its text comes in
    deltas of ``DELTA_CHARS`` code points; the first names the role.
    """
    text = F.coalesce("text", F.lit(""))
    named = rows.select(
        "conv_id", "turn", "role", text.alias("text"),
        F.monotonically_increasing_id().alias("message"),
    )
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / DELTA_CHARS).cast("int")
    parts = named.withColumn("seq", F.explode(F.sequence(F.lit(0), last)))
    return parts.select(
        "conv_id", "turn", "message", "seq",
        F.lit("delta").alias("kind"),
        F.when(F.col("seq") == 0, F.col("role")).alias("role"),
        F.substring("text", F.col("seq") * DELTA_CHARS + 1, F.lit(DELTA_CHARS)).alias("text"),
    )
