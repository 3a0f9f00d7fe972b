"""Byte-level BPE with an index from each pair to all its positions.

The different pre-tokens of a batch of texts are laid out as one list of
symbols. An index maps every mergeable pair to the positions where it stands;
the ranks of the pairs present are applied in ascending order, and each merge
updates only the lists of the pairs it touches. Texts then become the stored
sequences of their pre-tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 250_000
CACHE_WORD_CHARS = 64
#: Symbols laid out at once; longer single words are laid out alone.
LAYOUT_SYMBOLS = 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        ids: dict[str, int] = held["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.first = [ids[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.bytes = [bytes(back[c] for c in tokens.get(i, "")) for i in range(max(tokens) + 1)]
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(PRE_TOKEN)
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special tokens, in order; joined they give the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The packed ids of each word that is not stored yet."""
        new: dict[str, bytes] = {}
        todo: list[str] = []
        symbols = 0
        for w in words:
            if w in self.special:
                new[w] = self.special[w].to_bytes(4, "little")
                continue
            todo.append(w)
            symbols += len(w)
            if symbols >= LAYOUT_SYMBOLS:
                new |= self.encode_words(todo)
                todo, symbols = [], 0
        return new | self.encode_words(todo)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Merge all words together, lowest rank first."""
        symbol: list[int] = []
        starts = [0]
        for w in words:
            symbol += [self.first[b] for b in w.encode()]
            symbol.append(-1)
            starts.append(len(symbol))
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = self.merges
        where: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (symbol[i], symbol[i + 1])
            if pair in where:
                where[pair].append(i)
            elif pair in merges:
                where[pair] = [i]
        active = [(merges[p][0], p) for p in where]
        heapq.heapify(active)
        while active:
            rank, pair = heapq.heappop(active)
            at = where.pop(pair, None)
            if at is None:
                continue
            left, right = pair
            made = merges[pair][1]
            at.sort()
            for k, i in enumerate(at):
                if symbol[i] != left:
                    continue
                j = after[i]
                if j >= n or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = made, -2
                nxt = after[j]
                after[i] = nxt
                lower = False
                if nxt < n:
                    before[nxt] = i
                    lower = self._note(where, active, (made, symbol[nxt]), i, rank)
                prev = before[i]
                if prev >= 0:
                    lower |= self._note(where, active, (symbol[prev], made), prev, rank)
                if lower and k + 1 < len(at):  # a lower rank came up: it goes before the rest of this list
                    where.setdefault(pair, []).extend(at[k + 1 :])
                    heapq.heappush(active, (rank, pair))
                    break
        out = {}
        for w, s, e in zip(words, starts, starts[1:], strict=False):
            out[w] = b"".join(x.to_bytes(4, "little") for x in symbol[s:e] if x >= 0)
        return out

    def _note(self, where, active, pair: tuple[int, int], i: int, rank: int) -> bool:
        merge = self.merges.get(pair)
        if merge is None:
            return False
        if pair in where:
            where[pair].append(i)
        else:
            where[pair] = [i]
            heapq.heappush(active, (merge[0], pair))
        return merge[0] < rank

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        split = [self.pieces(t) for t in texts]
        new = self.learn(set(chain.from_iterable(split)).difference(self.known))
        self.known |= {w: ids for w, ids in new.items() if len(w) <= CACHE_WORD_CHARS}
        long = {w: ids for w, ids in new.items() if len(w) > CACHE_WORD_CHARS}
        known = self.known
        for words in split:
            if long:
                yield b"".join([known[w] if w in known else long[w] for w in words])
            else:
                yield b"".join(map(known.__getitem__, words))
        if len(known) > CACHE_WORDS:
            known.clear()

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that only their texts become Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(ids: list, texts: list, most_chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Consecutive rows with about ``most_chars`` characters of text; null is empty."""
    a: list = []
    b: list[str] = []
    held = 0
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        a.append(i)
        b.append(t)
        held += len(t)
        if held >= most_chars:
            yield a, b
            a, b, held = [], [], 0
    if a:
        yield a, b


def encode_documents(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``.

    ``ids`` (binary, little-endian 32-bit) is there unless ``with_ids`` is
    false. Texts are encoded whole and decoded again from their ids. A null
    text counts as empty and has no tokens; a null id stays null; repeated rows
    are encoded each; other columns are ignored; an empty table gives an empty
    result. ``path`` must name the vocabulary on every machine.
    """

    def run(batches):
        vocab = vocabulary(path)
        for batch in slices(batches):
            for ids, texts in chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = list(vocab.encode(texts))
                out = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(vocab.decode(p).encode()).hexdigest() for p in packed]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    out.append(pa.array(packed, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, schema + (", ids binary" if with_ids else ""))
