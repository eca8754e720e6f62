"""Chat formatting by event-sourced reconstruction.

The input is a log of events (conv_id, seq, kind, message, role, text):

* ``message``     starts message number ``message`` with a role and a text
* ``delta``       appends text to it
* ``edit``        replaces its text
* ``regenerate``  empties it and drops every message that was started after it

Events are partitioned by conversation and message, sorted by sequence and
folded into final messages; a window over the conversation then drops what a
regeneration made void and numbers the turns.  A turn is rendered as
``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every ``<``,
backslashes, ``|`` gets one more backslash, so no control string can occur in
them and reading back removes exactly what was added; a role also has its
backslashes doubled and its line feeds written as ``\\n``.

A task holds one message at a time, so a conversation with most of the events
is spread over tasks while it is folded; the digests stream through it.

Defined cases: null text or role is empty; a null conv_id is one conversation;
a null message number is one message of its conversation; events of unknown
kind do nothing; events that tie on seq are applied in the order of kind
(``message`` first), role and text; a delta or edit without a start starts its
message; a conversation with no messages left is absent; an empty log gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT = "conv_id long, seq long, kind string, message long, role string, text string"
KINDS = ("message", "delta", "edit", "regenerate")
START, END = "<|im_start|>", "<|im_end|>"
FOLDED = "conv_id long, message long, start long, role string, text string, voids long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Final state of each message; rows arrive sorted by conversation, message and sequence."""
    key, start, role, text, voids = None, None, "", [], None
    out: list[tuple] = []

    def packed():
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                          names=["conv_id", "message", "start", "role", "text", "voids"])

    for batch in batches:
        for conv, seq, kind, message, r, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (conv, message):
                if key is not None:
                    out.append((*key, start, role, "".join(text), voids))
                key, start, role, text, voids = (conv, message), seq, "", [], None
            if kind == "message":
                role, text = r or "", [t or ""]
            elif kind == "delta":
                role = role or r or ""
                text.append(t or "")
            elif kind == "edit":
                role, text = role or r or "", [t or ""]
            elif kind == "regenerate":
                text, voids = [], seq
        if len(out) > 4096:
            yield packed()
            out.clear()
    if key is not None:
        out.append((*key, start, role, "".join(text), voids))
    yield packed()


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn (from 0), role, text."""
    known = events.where(F.col("kind").isin(*KINDS)).select(
        *[F.col(c.split()[0]).cast(c.split()[1]) for c in EVENT.split(", ")])
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    folded = (
        known.repartition("conv_id", "message")
        .sortWithinPartitions("conv_id", "message", "seq", order, "role", "text")
        .mapInArrow(_fold, FOLDED)
    )
    earlier = W.partitionBy("conv_id").orderBy("start", "message")
    void_until = F.max("voids").over(earlier.rowsBetween(W.unboundedPreceding, -1))
    kept = folded.withColumn("void_until", void_until).where("void_until is null or start is null or void_until < start")
    return kept.select("conv_id", (F.row_number().over(earlier) - 1).cast("long").alias("turn"), "role", "text")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def render(messages: DataFrame, template_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, and the span of the conversation's output under the loss mask.

    The output of a conversation is its ``formatted`` strings in the order of
    turns; ``loss_start`` and ``loss_chars`` count code points in it (null
    where the turn carries no loss).
    """
    role = F.regexp_replace(F.regexp_replace(F.col("role"), r"\\", r"\\\\"), "\n", r"\\n")
    head = F.concat(F.lit(START), escape(role), F.lit("\n"))
    body = escape(F.col("text"))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    r = (
        messages.select("conv_id", "turn", head.alias("head"), body.alias("body"), F.col("role").isin(*template_roles).alias("loss"))
        .withColumn("formatted", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("at", F.coalesce(F.sum(F.length("formatted").cast("long")).over(before), F.lit(0)))
    )
    return r.select("conv_id", "turn", "formatted",
                    F.when(F.col("loss"), F.col("at") + F.length("head")).alias("loss_start"),
                    F.when(F.col("loss"), F.length("body").cast("long")).alias("loss_chars"))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    import re

    def plain(s):
        return re.sub(r"<\\(\\*)\|", r"<\1|", s)

    if not (formatted.startswith(START) and formatted.endswith(END + "\n")):
        raise ValueError("not a rendered turn")
    role, _, text = formatted[len(START):-len(END) - 1].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], plain(role)), plain(text)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib
    import re

    key, out = (), []

    def fresh():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def packed():
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                          names=[c.split()[0] for c in DIGEST.split(", ")])

    state = fresh()
    for batch in batches:
        for conv, formatted, start, chars in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (conv,):
                if key:
                    out.append((*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                key, state = (conv,), fresh()
            role, text = read_turn(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = formatted[start - state[4]:start - state[4] + chars]
                said = re.sub(r"<\\(\\*)\|", r"<\1|", masked)
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(formatted)
        if len(out) > 4096:
            yield packed()
            out.clear()
    if key:
        out.append((*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
    yield packed()


def digest(rendered: DataFrame) -> DataFrame:
    """What reading the rendered conversations back gives, one row per conversation."""
    return (rendered.select("conv_id", "turn", "formatted", "loss_start", "loss_chars")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn")
            .select("conv_id", "formatted", "loss_start", "loss_chars")
            .mapInArrow(_digest, DIGEST))


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log: each row is started, then streamed in two deltas.

    Rows of a conversation are ordered by turn (null first), then role and text.
    """
    row = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    text, half = F.coalesce(F.col("text"), F.lit("")), F.floor(F.length(F.coalesce(F.col("text"), F.lit(""))) / 2).cast("int")
    numbered = turns.select("conv_id", row.alias("message"), "role", text.alias("text"), half.alias("half"))
    m = F.col("message")
    parts = F.array(
        F.struct((m * 3).alias("seq"), F.lit("message").alias("kind"), F.col("role"), F.lit("").alias("text")),
        F.struct((m * 3 + 1).alias("seq"), F.lit("delta").alias("kind"), F.col("role"), F.expr("left(text, half)").alias("text")),
        F.struct((m * 3 + 2).alias("seq"), F.lit("delta").alias("kind"), F.col("role"), F.expr("substring(text, half + 1)").alias("text")),
    )
    return numbered.select("conv_id", "message", F.explode(parts).alias("e")).select("conv_id", "e.seq", "e.kind", "message", "e.role", "e.text")
