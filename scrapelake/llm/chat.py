"""Conversations as text with a loss mask, and back.

Turns of a conversation are rows; they are sorted by turn, then role and text. A template writes
each turn as ``### role: text</turn>`` and a line feed; texts are escaped by backslashes, so none
can hold a control string, and the assistant's texts are marked as generated.

Conversations are streamed: a partition is sorted by conversation, a template renders from an
iterator of turns, and the output is cut into parts of bounded size between turns' pieces. So
neither a conversation nor its text is ever held as a whole. Null texts and roles are empty. Turns
may be null, repeated or out of order; rows of a null conversation are one conversation. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrapelake.llm.templates import compile_template

TEMPLATE = (
    "{% for m in messages %}### {{ m.role | field }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
PART_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def escape_field(text: str) -> str:
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "field": escape_field, "upper": str.upper, "trim": str.strip}
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_PARTS = "conv_id bigint, part int, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Parts of every conversation's text, in order, with the mask's spans inside each part (code
    points, end exclusive). Rows of a conversation are neighbours, in order of ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["conv_id", "part", "formatted", "loss_starts", "loss_ends"]
        done: list[tuple] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names
            )

        rows = _rows(batches, "conv_id", "role", "text")
        for conv_id, turns in groupby(rows, itemgetter(0)):
            messages = ({"role": r or "", "text": t or ""} for _, r, t in turns)
            number, size, pieces, spans = 0, 0, [], []
            for piece, generated in render({"messages": messages}):
                if size >= PART_CHARS and not generated and piece.startswith("</turn>"):
                    pieces.append(piece)  # a part ends with its last turn's end
                    done.append((conv_id, number, "".join(pieces), *_sides(spans)))
                    yield out()
                    done, waiting = [], 0
                    number, size, pieces, spans = number + 1, 0, [], []
                    continue
                if generated:
                    if spans and spans[-1][1] == size:
                        spans[-1] = (spans[-1][0], size + len(piece))
                    else:
                        spans.append((size, size + len(piece)))
                pieces.append(piece)
                size += len(piece)
            if pieces:
                done.append((conv_id, number, "".join(pieces), *_sides(spans)))
                waiting += size
            if waiting >= PART_CHARS or len(done) >= 5000:
                yield out()
                done, waiting = [], 0
        if done:
            yield out()

    turns = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _PARTS)


def _sides(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    return [a for a, _ in spans], [b for _, b in spans]


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns, unescaped."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        yield unescape(m[1]), unescape(m[2])
    if at != len(text):
        raise ValueError(f"not a formatted turn: {text[at : at + 80]!r}")


def digests(parts: DataFrame) -> DataFrame:
    """What is read back from the parts of ``formatted``: turns, and all text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out() -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names
            )

        rows = _rows(batches, "conv_id", "formatted", "loss_starts", "loss_ends")
        for conv_id, own in groupby(rows, itemgetter(0)):
            count, loss_chars, chars = 0, 0, 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, text, starts, ends in own:
                chars += len(text)
                for role, said in turns_of(text):
                    count += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    learnt = unescape(text[a:b])
                    loss_chars += len(learnt)
                    loss.update(learnt.encode())
            found.append((conv_id, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(found) >= 5000:
                yield out()
                found = []
        if found:
            yield out()

    return parts.mapInArrow(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
