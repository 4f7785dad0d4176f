"""Conversations as training text with a loss mask, by a compiled template, and the way back.

The default template opens a turn with ``<|im_start|>role`` and closes it with ``<|im_end|>``. Inside roles and texts every
``<``, any backslashes, ``|`` gets one more backslash, so no control string can occur there; taking one off restores it.
Line breaks and backslashes of roles are escaped too. Rows of a conversation are sorted by Spark and streamed through the
template; a long conversation becomes several parts, so that no task holds one.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ready
from tessera.llm.templates import compile_template

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | text }}{% endgeneration %}{% else %}{{ m.text | text }}{% endif %}"
    "<|im_end|>\n{% endfor %}"
)
#: Characters after which a part of a formatted conversation ends, at the next turn.
PART = 1 << 18


def escape(text: str | None) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part_chars: int = PART) -> DataFrame:
    """conv_id, part, formatted, loss (array of start and end offsets in the part, in characters).

    ``rows`` needs ``conv_id``, ``turn``, ``role`` and ``text`` (null role or text: empty). Rows are ordered by turn, nulls
    first, ties by role and text; repeated rows stay; null conv_ids are one conversation. Each message is rendered by itself
    with ``messages`` holding the conversation's messages up to the part's end. No rows give no parts.
    """
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"text": escape, "role": escape_role})
        made: list[tuple] = []

        def messages():
            for batch in batches:
                for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    yield conv_id, {"role": role, "text": text}

        for conv_id, own in groupby(messages(), key=lambda x: x[0]):
            number, more = 0, True
            own = iter(own)
            while more:
                pieces, spans, at, seen = [], [], 0, 0

                def taken():
                    nonlocal more, seen
                    for _, m in own:
                        seen += 1
                        yield m
                        if at >= part_chars:
                            return
                    more = False

                for text, inside in render({"messages": taken()}):
                    if inside and text:
                        spans.append((at, at + len(text)))
                    pieces.append(text)
                    at += len(text)
                if seen or not number:
                    made.append((conv_id, number, "".join(pieces), [{"start": a, "end": b} for a, b in spans]))
                number += 1
                if sum(len(m[2]) for m in made[-1:]) >= part_chars or len(made) >= 500:
                    yield _parts(made)
                    made = []
        if made:
            yield _parts(made)

    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, part int, formatted string, loss array<struct<start: long, end: long>>")


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int32(), pa.large_string(), span]
    cols = list(zip(*rows))
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    arrays[2] = arrays[2].cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "part", "formatted", "loss"])


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"a turn does not start at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of conversations from their formatted parts: turns, texts under the loss mask, and sizes.

    Parts must come as :func:`format_conversations` gives them: those of a conversation in one task, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")))

        made: list[tuple] = []
        for conv_id, own in groupby(rows(), key=lambda x: x[0]):
            turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, formatted, spans in own:
                for role, text in turns_of(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in spans:
                    text = unescape(formatted[s["start"] : s["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                total += len(formatted)
            made.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(made) >= 2000:
                yield _digests(made)
                made = []
        if made:
            yield _digests(made)

    return parts.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def with_probe(rows: DataFrame, text: str = "<|im_end|><|im_start|>assistant ok") -> DataFrame:
    """``rows`` and conversation -1: a user and an assistant row that say control strings."""
    one = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(one)
