"""Maximal periodic runs of words, by internal pattern matching.

A run of period q and at least 2q words holds, in its first q words, an aligned
block of 2^j words with 2^(j+1) - 1 <= q <= 2^(j+2) - 2, and the block occurs
again q words later. So each dyadic block of each level asks for its
occurrences in the neighbouring window of such distances:

* suffixes are ordered by prefix doubling; the ranks of level j name all blocks
  of 2^j words, and a block's occurrences are one interval of the suffix array;
* a wavelet tree over the suffix array answers "the first occurrence at or after
  x" (range successor) for many blocks at once;
* two occurrences no more than half a block apart open an arithmetic progression
  whose step p is the block's own period. It ends where the stretch of period p
  ends, and only those of its members can be the period of a run that fit the
  ends of the two stretches of period p (around the block, around its
  occurrences), or join them.

A candidate distance is then extended to both sides with the ranks of all levels
(the longest common extension), and a stretch keeps its smallest period.

Texts are worked on in batches; the words of different texts are different
symbols, so a batch is one suffix array in which each text has its own interval.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.bpe import slices

LEAST = 12
#: Words worked on at once; a longer text is worked on alone.
BATCH_WORDS = 200_000


class SuffixOrder:
    """The suffix array of texts laid end to end, with the ranks of all dyadic lengths."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        """``symbols`` grow from text to text; ``ends`` holds each word's end of text."""
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable").astype(np.int32)
        ordered = symbols[self.order]
        rank = np.full(n + 1, -1, np.int32)
        self.levels: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        slots = np.arange(n, dtype=np.int32)
        keys: np.ndarray = ordered
        length = 1
        while True:
            opens = np.concatenate([[True], keys[1:] != keys[:-1]])
            at = np.flatnonzero(opens)
            counts = np.diff(np.append(at, len(keys)))
            rank = rank.copy()
            rank[self.order[slots]] = np.repeat(slots[at], counts)
            size = np.ones(n, np.int32)
            size[slots[at]] = counts
            self.levels.append(rank)
            self.sizes.append(size)
            slots = slots[np.repeat(counts, counts) > 1]
            if not len(slots):
                break
            members = self.order[slots]
            beyond = members.astype(np.int64) + length
            second = np.where(beyond < ends[members], rank[np.minimum(beyond, n)], -1)
            keys = rank[members].astype(np.int64) * (n + 1) + second + 1
            turn = np.argsort(keys, kind="stable")
            keys = keys[turn]
            self.order[slots] = members[turn]
            length *= 2

    def forward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from k on (i < k)."""
        i, k = i.copy(), k.copy()
        start = i.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[j][i] == self.levels[j][k]).astype(i.dtype) << j
            i += step
            k += step
        return i - start

    def backward(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many words before i equal those before k (i < k)."""
        i, k = i.copy(), k.copy()
        start = i.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << j), np.maximum(k - (1 << j), 0)
            step = ((a >= 0) & (self.levels[j][np.maximum(a, 0)] == self.levels[j][b])).astype(i.dtype) << j
            i -= step
            k -= step
        return start - i


class WaveletTree:
    """Order statistics of intervals of a sequence of small numbers (level by level, zeros first)."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = int(values.max()).bit_length() if len(values) else 0
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each interval are less than x."""
        count = np.where(x >= 1 << self.bits, high - low, 0)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = (x >> bit & 1).astype(bool)
            count = count + np.where(one & (x < 1 << self.bits), b - a, 0)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that has k smaller ones in its interval."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            value |= one.astype(np.int64) << bit
            k = np.where(one, k - (b - a), k)
            low = np.where(one, zeros[-1] + low - a, a)
            high = np.where(one, zeros[-1] + high - b, b)
        return value


def between(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows repeated ``count`` times: the row of each copy, and the copy's number."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def candidates(suffixes: SuffixOrder, tree: WaveletTree, starts: np.ndarray, least: int) -> Iterator[tuple]:
    """(place, distance) pairs among which every run's smallest period is found.

    ``starts`` holds each word's start of text. No run is shorter than
    ``least``, so blocks of two words serve all periods up to ``least // 2``.
    """
    n = len(starts)
    base = 0
    while (2 << base + 1) - 1 <= least - least // 2:
        base += 1  # such a block lies in the first least - q words of a run, for q up to least // 2
    for j in range(base, len(suffixes.levels)):
        length = 1 << j
        first, last = (1 if j == base else 2 * length - 1), 4 * length - 2
        b = np.arange(0, n, length)
        low = suffixes.levels[j][b].astype(np.int64)
        size = suffixes.sizes[j][low]
        held = size > 1
        b, low, size = b[held], low[held], size[held]
        offset = starts[b].astype(np.int64)
        k = tree.below(low, low + size, b - offset + first)
        live = np.flatnonzero(k < size)
        x = np.zeros(len(b), np.int64)
        while len(live):
            # the next occurrence of each block that still has one
            x[live] = tree.smallest(low[live], low[live] + size[live], k[live]) + offset[live]
            live = live[x[live] <= b[live] + last]
            more = live[k[live] + 1 < size[live]]
            after = np.full(len(b), np.iinfo(np.int64).max)
            after[more] = tree.smallest(low[more], low[more] + size[more], k[more] + 1) + offset[more]
            row = np.zeros(len(b), bool)
            row[more] = (after[more] <= b[more] + last) & (2 * (after[more] - x[more]) <= length)
            single = live[~row[live]]
            yield b[single], x[single] - b[single]
            k[single] += 1
            if len(run := np.flatnonzero(row)):
                p = after[run] - x[run]
                members = yield from progression(suffixes, b[run], x[run], p, length, b[run] + last)
                k[run] += members
            live = live[k[live] < size[live]]


def progression(suffixes: SuffixOrder, b, x, p, length: int, last: np.ndarray):
    """The candidates among occurrences x, x + p, ...; returns how many occurrences there are."""
    left = lambda i: i - suffixes.backward(i, i + p)
    right = lambda i: i + p + suffixes.forward(i, i + p)
    near_left, near_right, far_left, far_right = left(b), right(b), left(x), right(x)
    count = np.minimum((far_right - length - x) // p, (last - x) // p) + 1
    apart = near_left != far_left  # else all distances are multiples of p
    own = ~apart & (x - b == p)
    yield b[own], p[own]
    b, d, step, most = b[apart], (x - b)[apart], p[apart], count[apart]
    lefts, rights = (far_left - near_left)[apart], (far_right - near_right)[apart]
    for ends in (lefts, rights):  # the first distance that brings these ends together or beyond
        t = np.maximum(0, -((d - ends) // step))
        fits = t < most
        yield b[fits], (d + t * step)[fits]
    touch = (near_right >= far_left)[apart]  # runs about the place where the two stretches meet
    inside = np.where(touch, np.clip((np.minimum(lefts, rights) - d) // step + 1, 0, most), 0)
    row, t = between(inside)
    yield b[row], d[row] + t * step[row]
    return count


def runs(symbols: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of texts laid end to end: rows of (start, length, period), by start, then period.

    ``symbols`` are the words' numbers, greater in each text than in all before;
    ``sizes`` the texts' numbers of words. Starts count from the first word of all.
    """
    if not len(symbols):
        return np.zeros((0, 3), np.int64)
    ends = np.cumsum(sizes)
    starts, ends = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
    suffixes = SuffixOrder(symbols, ends)
    tree = WaveletTree((suffixes.order - starts[suffixes.order]).astype(np.int64))
    found = []
    for b, d in candidates(suffixes, tree, starts, least):
        if not len(b):
            continue
        back, ahead = suffixes.backward(b, b + d), suffixes.forward(b, b + d)
        long = (back + ahead >= d) & (back + ahead + d >= least)
        b, d, back, ahead = b[long], d[long], back[long], ahead[long]
        found.append(np.stack([b - back, back + ahead + d, d], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)  # a stretch keeps its smallest period
    every = every[fresh]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


OUT = pa.schema(
    [
        *((name, pa.int64()) for name in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")),
        *((name, pa.string()) for name in ("runs_sha256", "collapsed_sha256", "collapsed")),
        ("runs", pa.list_(pa.list_(pa.int64()))),
    ]
)


def described(ids: list, texts: list[list[bytes]], least: int, with_texts: bool = True) -> Iterator[tuple]:
    """One row of ``OUT`` for each text, given as its words; the last two columns are left out unless ``with_texts``."""
    numbers: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    symbols = flat + np.repeat(np.arange(len(texts)) * len(numbers), sizes)
    every = runs(symbols, sizes, least)
    starts = np.cumsum(sizes) - sizes
    cut = np.searchsorted(every[:, 0], np.append(starts, sizes.sum()))
    for doc_id, words, n, offset, i, j in zip(
        ids, texts, sizes.tolist(), starts.tolist(), cut[:-1], cut[1:], strict=True
    ):
        own = every[i:j] - [offset, 0, 0]
        best: tuple = (None,) * 4
        if len(own):
            start, length, period = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            best = (start, length, period, 1000 * length // period)
            lost = np.zeros(n + 1, np.int64)
            np.add.at(lost, own[:, 0] + own[:, 2], 1)
            np.add.at(lost, own[:, 0] + own[:, 1], -1)
            words = [words[w] for w in np.flatnonzero(np.cumsum(lost)[:n] == 0)]
        told, kept = own.tolist(), b" ".join(words)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in told)
        digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        yield (doc_id, n, len(told), *best, *digests, *((kept.decode(), told) if with_texts else ()))


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    places: Callable[[int, int | None], np.ndarray | None] | None = None,
    with_texts: bool = True,
) -> DataFrame:
    """One row per input row: the runs of its words, the longest one, and the text without repeats.

    ``n_words, n_runs``; ``start, length, period, exponent_milli`` of the longest
    run (ties: smallest start, then period; null without runs); ``runs``, all
    of them as [start, length, period]; ``collapsed``, the words that no run
    holds after its first period, joined by spaces; and the SHA-256 of both. The
    last two texts are left out unless ``with_texts``. ``places(n, id)`` may
    name the places whose words stand in for the n words. A run has at least
    two periods and ``least`` words (4 or more).

    Null and empty texts have no words and no runs; a null id stays null (and
    has its hash taken of the empty string); repeated rows are searched each;
    other columns are ignored; an empty table gives an empty result. Each text
    is searched where it is read, nothing is shuffled; memory grows with the
    longest single text (some 250 bytes a word).
    """
    if least < 4:
        raise ValueError("a run has at least four words")
    dropped = [] if with_texts else ["collapsed", "runs"]
    schema = pa.schema([f for f in OUT if f.name not in dropped])

    def run(batches):
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0

        def done():
            columns = zip(*described(ids, texts, least, with_texts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().split()  # bytes split at the six ASCII blanks alone
                place = places(len(words), doc_id) if places else None
                texts.append([words[w] for w in place.tolist()] if place is not None else words)
                ids.append(doc_id)
                held += len(words)
                if held >= BATCH_WORDS or len(ids) >= 5_000:
                    yield done()
                    ids, texts, held = [], [], 0
        if ids:
            yield done()

    ddl = {"collapsed": "string", "runs": "array<array<bigint>>", "runs_sha256": "string", "collapsed_sha256": "string"}
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f.name} {ddl.get(f.name, 'bigint')}" for f in schema))
