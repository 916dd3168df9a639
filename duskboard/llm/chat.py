"""Operator 3: conversations as training text with a loss mask, by a compiled template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskboard.llm.template import compile_template

#: Marks turns; the text of an assistant is what a model generates.
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_line }}\n"
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}'
    "<|im_end|>\n{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Takes the meaning from control strings: no "<|" is left. ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_chats(
    turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: its text and the spans (code points, end exclusive) a model is trained on.

    Turns stand in the order of their number, null first; equal ones by role and text, so repeated rows stay as
    often as they come. A null role or text is empty. Turns with a null id are one conversation with a null id.
    Other columns are ignored; an empty table gives no rows. Rows reach a task sorted and are read one
    conversation at a time, so a task holds the longest conversation, which is also one row of its result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape, "escape_line": escape_line})
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        out, size = [], 0

        def batch(some: list[tuple]) -> pa.RecordBatch:
            ids, counts, texts, spans = zip(*some, strict=True)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            listed = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "n_turns": pa.array(counts, pa.int64()), "formatted": pa.array(texts, pa.string()), "loss_spans": listed})

        for conv, own in groupby(rows, key=lambda r: r[0]):
            messages = [{"role": role, "text": text} for _, role, text in own]
            text, spans = render({"messages": messages})
            out.append((conv, len(messages), text, spans))
            size += len(text)
            if size > 4 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    cols = turns.select(
        F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))),
    )
    ordered = cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a text formatted by ``TEMPLATE`` came from."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of what stands in formatted conversations: their turns, and the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse_chat(text)
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (all_turns, loss)]
                out.append((conv, len(turns), digests[0], len(loss), digests[1], len(text)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = [c.split()[0] for c in READ.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, READ)
