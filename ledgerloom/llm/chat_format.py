"""Conversations as training texts, with the spans the model learns from.

A compiled template (``chat_template``) renders the turns of each conversation,
which one shuffle brings together in order. Nothing holds a conversation as a
whole: turns stream through the template, and the text comes in pieces of
bounded size (with one turn's text more at most). The default template begins
each turn by ``### role: `` and ends it by ``</turn>``; a backslash inside texts
and roles marks each place where such a string begins, so a text cannot forge
a turn, and reading back gives the turns as they were.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import slices
from ledgerloom.llm.chat_template import BEGIN, END, compiled, unescape

TEMPLATE = """\
{%- for message in messages -%}
### {{ message.role | escape(':') }}: {# the space belongs to the mark #}
{%- if message.role == 'assistant' -%}
{%- generation -%}{{ message.text | escape('###', '</turn>') }}{%- endgeneration -%}
{%- else -%}
{{ message.text | escape('###', '</turn>') }}
{%- endif -%}
{{ '</turn>\\n' }}
{%- endfor -%}
"""
#: One turn of the default template.
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
PIECE_CHARS = 1_000_000

Piece = tuple[str, list[tuple[int, int]]]


def pieces(template: str, messages: Iterable[dict], most_chars: int = PIECE_CHARS) -> Iterator[Piece]:
    """The rendered text in pieces, each with its spans under the loss mask (code points)."""
    held: list[str] = []
    spans: list[tuple[int, int]] = []
    size, begun = 0, None
    for part in compiled(template)({"messages": messages}):
        if part is BEGIN:
            begun = size
        elif part is END:
            spans.append((begun, size))
            begun = None
        else:
            held.append(part)
            size += len(part)
            if size >= most_chars:
                if begun is not None:
                    spans.append((begun, size))
                yield "".join(held), spans
                held, spans, size, begun = [], [], 0, None if begun is None else 0
    if held or spans:
        yield "".join(held), spans


def turns(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text in the default template, given in pieces."""
    rest = ""
    for text in texts:
        rest += text
        at = 0
        while m := TURN.match(rest, at):
            yield unescape(m[1]), unescape(m[2])
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("the text does not end with a whole turn")


def consecutive(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Rows of neighbouring equal first columns."""
    rows = (row for b in slices(batches) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[0])


def format_conversations(
    rows: DataFrame,
    template: str = TEMPLATE,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    most_chars: int = PIECE_CHARS,
) -> DataFrame:
    """The formatted conversations in pieces: ``conv_id, piece, text, spans``.

    A template sees ``messages``, each with ``role`` and ``text``, in the order
    of turn (null first), then role and text. ``spans`` are [from, to) pairs of
    code points of the piece under the loss mask. Pieces of a conversation come
    in order in one partition. Null texts and roles are empty; rows without an
    id form one conversation without one; repeated rows are turns of their own;
    other columns are ignored; an empty table gives an empty result. A
    template that breaks the language's rules raises TemplateError at once.
    A conversation is written by one task, as a stream.
    """
    compiled(template)
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for conv_id, own in consecutive(batches):
            messages = ({"role": role or "", "text": text or ""} for _, _, role, text in own)
            for i, (text, spans) in enumerate(pieces(template, messages, most_chars)):
                out.append((conv_id, i, text, spans))
                held += len(text)
                if held >= PIECE_CHARS:
                    yield batch_of(out, schema)
                    out, held = [], 0
        if out:
            yield batch_of(out, schema)

    columns = [
        rows[id_column].cast("long").alias("conv_id"),
        rows[turn_column].cast("long").alias("turn"),
        rows[role_column].alias("role"),
        rows[text_column].alias("text"),
    ]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, piece long, text string, spans array<array<long>>")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_back(formatted: DataFrame, ordered: bool = False) -> DataFrame:
    """What conversations in the default template hold, read from their pieces.

    One row per conversation: ``conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars``; the first digest is of each turn's role,
    line end, text, line end, the second of all unescaped text under the loss
    mask. ``ordered`` says that the pieces of a conversation stand together in
    order, as ``format_conversations`` leaves them; else they are brought
    together first. A text that is not in the format raises.
    """
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("n_turns", pa.int64()),
            ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()),
            ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()),
        ]
    )

    def told(own: Iterator[tuple]) -> tuple:
        said, loss = hashlib.sha256(), hashlib.sha256()
        counts = {"turns": 0, "loss": 0, "chars": 0}

        def texts() -> Iterator[str]:
            for _, _, text, spans in own:
                counts["chars"] += len(text)
                for a, b in spans:
                    learned = unescape(text[a:b])
                    counts["loss"] += len(learned)
                    loss.update(learned.encode())
                yield text

        for role, text in turns(texts()):
            counts["turns"] += 1
            said.update(f"{role}\n{text}\n".encode())
        return counts["turns"], said.hexdigest(), counts["loss"], loss.hexdigest(), counts["chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, own in consecutive(batches):
            out.append((conv_id, *told(own)))
            if len(out) >= 10_000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    rows = formatted.select("conv_id", "piece", "text", "spans")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(run, names)
