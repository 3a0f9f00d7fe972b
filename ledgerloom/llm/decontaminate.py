"""Benchmark items inside documents, by pigeonhole edit matching.

An item of n characters may differ by ``k = floor(rate * n)`` edits. Cut into
k + 1 pieces, at least one piece of every such occurrence is untouched, so an
exact search for the pieces finds all places worth a look. Each place is
verified with Myers' bit-parallel edit distance against the text around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import chunks, slices
from ledgerloom.llm.common import stored

ERROR_RATE = 0.08
#: Characters of items that one pass over the documents searches for.
BLOCK_CHARS = 2_000_000


def normal(text: str) -> str:
    """Lower case, every run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> Iterator[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of about equal length, with their offsets."""
    parts = errors + 1
    for i in range(parts):
        start, end = i * len(item) // parts, (i + 1) * len(item) // parts
        yield start, item[start:end]


class Pattern:
    """One item, ready for Myers' search."""

    def __init__(self, item: str, errors: int) -> None:
        self.item, self.errors = item, errors
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least(self, text: str) -> tuple[int, int]:
        """The least distance of the item to any part of ``text``, and where that part ends."""
        ones, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = ones, 0, self.size
        best, at = self.size + 1, 0
        get = self.masks.get
        for j, c in enumerate(text):
            same = get(c, 0)
            zero = (((same & up) + up) ^ up) | same | down
            plus = down | (ones & ~(zero | up))
            minus = up & zero
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & ones, minus << 1 & ones
            up = minus | (ones & ~(zero | plus))
            down = plus & zero
            if score < best:
                best, at = score, j + 1
        return best, at


class Matcher:
    """All items of one block, searched together."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.patterns: list[tuple[int, Pattern]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text)
            if not item:
                continue
            errors = int(rate * len(item))
            for offset, piece in pieces(item, errors):
                places.setdefault(piece, []).append((len(self.patterns), offset))
            self.patterns.append((item_id, Pattern(item, errors)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """``item_id, edits, end`` of the best occurrence of every item found in a normalised text."""
        if not self.patterns:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for p, offset in where:
                pattern = self.patterns[p][1]
                start = end + 1 - length - offset - pattern.errors
                stop = start + pattern.size + 2 * pattern.errors
                spans = windows.setdefault(p, [])
                if spans and spans[-1][1] >= start >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
        out = []
        for p, spans in windows.items():
            item_id, pattern = self.patterns[p]
            best = None
            for start, stop in joined(spans):
                edits, at = pattern.least(text[max(0, start) : max(0, stop)])
                if edits <= pattern.errors and (best is None or edits < best[0]):
                    best = (edits, max(0, start) + at)
            if best:
                out.append((item_id, *best))
        return out


def joined(spans: list[list[int]]) -> Iterator[tuple[int, int]]:
    """Overlapping spans as one."""
    start = stop = None
    for a, b in sorted(spans):
        if stop is None or a > stop:
            if stop is not None:
                yield start, stop
            start, stop = a, b
        else:
            stop = max(stop, b)
    if stop is not None:
        yield start, stop


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    rate: float = ERROR_RATE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, edits, end_char``.

    ``edits`` is the least edit distance of the normalised item to any part of
    the normalised text, and ``end_char`` where that part first ends (code
    points of the normalised text). Items are searched in blocks, every block
    against all rows. Null or empty texts and items match nothing; null ids
    stay null in the rows they lead to; repeated rows are reported each; other
    columns are ignored; empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, edits long, end_char long"
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    wanted = items.select(items[item_column].cast("long"), items[item_text]).where(F.col(item_text).isNotNull())

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in slices(batches):
                for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits = [(i, *h) for i, t in zip(ids, texts, strict=True) for h in matcher.search(normal(t))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h[k] for h in hits], pa.int64()) for k in range(4)],
                        names=["doc_id", "item_id", "edits", "end_char"],
                    )

        return rows.mapInArrow(run, schema)

    found: list[DataFrame] = []
    for block in item_blocks(wanted, block_chars):
        if found:  # more than one block: keep each result, not its plan
            found[-1] = stored(found[-1], "contaminated")
        found.append(searched(block))
    return reduce(DataFrame.unionByName, found) if found else searched([])


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    rate: float = ERROR_RATE,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows are judged one by one."""
    wanted = items.select(items[item_column].cast("long"), items[item_text]).where(F.col(item_text).isNotNull())
    at = docs.columns.index(text_column)

    def clean(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def run(batches):
            matcher = Matcher(block, rate)
            for batch in slices(batches):
                stays = [not (t and matcher.search(normal(t))) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(stays, pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    out, blocks = docs, 0
    for block in item_blocks(wanted, block_chars):
        out = clean(stored(out, "decontaminated") if blocks else out, block)
        blocks += 1
    return out
