"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
its text (not the marks around it) bears loss. A row holds the turns that are new since the example before (`added`, ending with the
head of the reply's turn), the reply, and the whole context as text if it has at most
`inline_chars`. A longer one is given by reference, conv_id and prefix_chars: it is what the conversation's rows up to this one hold, joined in order, so
that a long conversation makes rows in proportion to its turns, not to their square. `examples` reads the rows and
yields every example whole. Turns after the last reply, and `PENDING_CHARS` of turns that have no reply yet, are rows without a reply.
A conversation's rows go through one task in order, turn by turn; what it holds at once are its context and a batch.

Template: `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles and texts a backslash becomes two and
`<|` becomes `<\\|`, so no text can hold a mark, and unescaping gives the text back.

Null text or role: empty. Equal turns are ordered by role, then text; repeated rows stay. Null turn comes first.
Null conv_id: one conversation. No assistant turn: no example, the turns still stand in the output. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialise, shuffle_partitions, small_batches, table
from .tokens import slices

START, END = "<|im_start|>", "<|im_end|>\n"
INLINE_CHARS = 100_000
PENDING_CHARS = 1_000_000

ROWS = "conv_id long, example long, n_turns long, prefix_chars long, context string, added string, reply string"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPED = re.compile(r"\\([\\|n])")


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], s) if "\\" in s else s


def unescape_role(s: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], s)


def by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order)


def format_examples(conversations: DataFrame, inline_chars: int = INLINE_CHARS) -> DataFrame:
    """conversations (conv_id, turn, role, text) to ROWS; rows of a conversation follow each other in order."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        conv, open_conv, example, pending, n_pending, prefix, context = None, False, 0, "", 0, 0, ""

        def emit(reply):
            nonlocal example, pending, n_pending, prefix, context
            whole = prefix + len(pending)
            context = context + pending if context is not None and whole <= inline_chars else None
            out.append((conv, example if reply is not None else None, n_pending, whole, context, pending, reply))
            if reply is not None:
                example += 1
            prefix = whole + len(reply or "")
            context = context + (reply or "") if context is not None and prefix <= inline_chars else None
            pending, n_pending = "", 0

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.record_batch([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)], names=["conv_id", "example", "n_turns", "prefix_chars", "context", "added", "reply"])

        for b in slices(batches):
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if not open_conv or c != conv:
                    if n_pending:
                        emit(None)
                    conv, open_conv, example, pending, n_pending, prefix, context = c, True, 0, "", 0, 0, ""
                head = f"{START}{escape_role(role)}\n"
                n_pending += 1
                if role == "assistant":
                    pending += head
                    emit(escape(text) + END)
                else:
                    pending += head + escape(text) + END
                    if len(pending) > PENDING_CHARS:
                        emit(None)
            yield flush()
        if n_pending:
            emit(None)
        yield flush()

    return by_conversation(turns, "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(lean(run), ROWS)


def examples(rows: DataFrame) -> DataFrame:
    """Every example of the formatted rows, whole: conv_id, example, context (all turns before the reply, and its head), reply."""

    def run(batches):
        import pyarrow as pa

        conv, parts = object(), []
        for b in batches:
            for c, n, added, reply in zip(*(b.column(x).to_pylist() for x in ("conv_id", "example", "added", "reply")), strict=True):
                if c != conv:
                    conv, parts = c, []
                parts.append(added)
                if reply is not None:
                    yield pa.record_batch([pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([reply], pa.string())], names=["conv_id", "example", "context", "reply"])
                    parts.append(reply)

    return by_conversation(rows, "prefix_chars").select("conv_id", "example", "added", "reply").mapInArrow(lean(run), "conv_id long, example long, context string, reply string")


def read_back(rows: DataFrame, ordered: bool = False) -> DataFrame:
    """What a reader of the formatted rows finds. ordered: rows come as format_examples gives them. formatted_chars counts a conversation's marked text once."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple] = []
        conv, state = None, None

        def close():
            out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 6
            out.clear()
            return pa.record_batch([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, prefix, context, added, reply in zip(*(b.column(x).to_pylist() for x in ("conv_id", "prefix_chars", "context", "added", "reply")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if prefix != state[4] + len(added) or context is not None and (len(context) != prefix or not context.endswith(added)):
                    raise ValueError(f"conversation {c}: an example's context isn't what stands before it")
                for turn in (added + (reply or "")).split(START)[1:]:
                    role, _, text = turn.removesuffix(END).partition("\n")
                    state[0] += 1
                    state[1].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                if reply is not None:
                    target = unescape(reply.removesuffix(END))
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(added) + len(reply or "")
            yield flush()
        if state is not None:
            close()
        yield flush()

    if not ordered:
        rows = by_conversation(rows, "prefix_chars")
    return rows.select("conv_id", "prefix_chars", "context", "added", "reply").mapInArrow(lean(run), READ)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(materialise(format_examples(talk.unionByName(own)), "chat-examples"))
