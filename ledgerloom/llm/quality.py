"""Document quality by a factorisation machine.

The features of a text are its different words, hashed, and a few statistics of
its structure and length. The score is a logistic model of all features and of
all pairs of them, where the weight of a pair is the inner product of two short
vectors; the sum over pairs follows in linear time from the square of the sum
less the sum of the squares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import chunks, slices

BUCKETS = 1 << 15
RANK = 8
#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.3

UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
STOPS = b".,;:?"
STATS = 17


def statistics(text: str, words: list[str], counts: Counter, meta: float) -> list[float]:
    """Structure statistics; shares are square roots, so that small ones count."""
    raw = text.encode("utf-8", "replace")
    size, n = max(1, len(raw)), max(1, len(words))
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    lines = text.split("\n")
    top = max(counts.values(), default=0)
    shares = [
        without(UPPER) / size,
        without(DIGITS) / size,
        without(SYMBOLS) / size,
        without(STOPS) / size,
        raw.count(b"!") / size,
        raw.count(b"|") / n,
        without(b"\"'()") / size,
        (len(raw) - len(text)) / size,
        len(counts) / n,
        top / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        sum(map(str.isupper, counts)) / max(1, len(counts)),
    ]
    return [
        *(s**0.5 for s in shares),
        np.log1p(n),
        np.log1p(len(text) / n),
        np.log1p(n / len(lines)),
        np.log1p(max(0.0, meta)),
    ]


@lru_cache(maxsize=100_000)
def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % buckets


def features(text: str, meta: float | None, buckets: int) -> tuple[np.ndarray, list[float]]:
    """The buckets of the text's different words, and its statistics."""
    words = text.split()
    counts = Counter(words)
    ids = {bucket(w.lower(), buckets) if len(w) <= 64 else zlib.crc32(w.lower().encode()) % buckets for w in counts}
    stats = statistics(text, words, counts, len(text) if meta is None else meta)
    return np.fromiter(ids, np.int32, len(ids)), stats


@dataclass
class Machine:
    """Weights of a factorisation machine over hashed words and statistics."""

    bias: float
    linear: np.ndarray  # of words, then of statistics
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.linear) - STATS

    def inputs(self, ids: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows' features in one run: index, value and first position of each row."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        index = np.concatenate([np.concatenate([i, np.arange(STATS) + self.buckets]) for i in ids]).astype(np.int64)
        value = np.concatenate(
            [np.concatenate([np.full(len(i), 1 / np.sqrt(max(1, len(i)))), z[k]]) for k, i in enumerate(ids)]
        )
        starts = np.concatenate([[0], np.cumsum([len(i) + STATS for i in ids])[:-1]])
        return index, value, starts

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and each row's sums of factors."""
        weighted = self.factors[index] * value[:, None]
        sums = np.add.reduceat(weighted, starts)
        squares = np.add.reduceat(weighted * weighted, starts)
        line = np.add.reduceat(self.linear[index] * value, starts)
        return self.bias + line + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def scores(self, ids: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids))
        begin = held = 0
        for k in range(len(ids)):  # bounded pieces, so that gathered factors stay small
            held += len(ids[k]) + STATS
            if held >= 100_000 or k + 1 == len(ids):
                y, _ = self.raw(*self.inputs(ids[begin : k + 1], stats[begin : k + 1]))
                out[begin : k + 1] = 1 / (1 + np.exp(-np.clip(y, -30, 30)))
                begin, held = k + 1, 0
        return out


def fit(
    ids: list[np.ndarray],
    stats: np.ndarray,
    labels: np.ndarray,
    buckets: int = BUCKETS,
    rank: int = RANK,
    epochs: int = 8,
    rate: float = 0.05,
    decay: float = 1e-4,
    batch: int = 256,
    seed: int = 7,
) -> Machine:
    """Logistic loss by mini-batches with per-weight step sizes."""
    rng = np.random.default_rng(seed)
    size = buckets + STATS
    mean = stats.mean(axis=0) if len(stats) else np.zeros(STATS)
    scale = stats.std(axis=0) + 1e-6 if len(stats) else np.ones(STATS)
    rate_of_ones = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    m = Machine(float(np.log(rate_of_ones / (1 - rate_of_ones))), np.zeros(size), rng.normal(0, 0.01, (size, rank)), mean, scale)
    if len(labels) == 0 or labels.min() == labels.max():
        return m
    seen_bias, seen_linear, seen_factors = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            index, value, starts = m.inputs([ids[r] for r in rows], stats[rows])
            y, sums = m.raw(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[rows]) / len(rows)
            lengths = np.diff(np.append(starts, len(index)))
            e = np.repeat(error, lengths) * value
            own = m.factors[index]
            order_in = np.argsort(index, kind="stable")
            used, first = np.unique(index[order_in], return_index=True)
            each = np.column_stack([e, e[:, None] * (np.repeat(sums, lengths, axis=0) - own * value[:, None])])
            grad = np.add.reduceat(each[order_in], first)
            g, gf = grad[:, 0] + decay * m.linear[used], grad[:, 1:] + decay * m.factors[used]
            seen_linear[used] += g * g
            seen_factors[used] += gf * gf
            seen_bias += error.sum() ** 2
            m.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            m.factors[used] -= rate * gf / np.sqrt(seen_factors[used])
            m.bias -= rate * error.sum() / np.sqrt(seen_bias)
    return m


def fold(id_column: Column) -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")))


def _rows(df: DataFrame, id_column: str, text_column: str, meta_column: str) -> list[Column]:
    meta = df[meta_column].cast("double") if meta_column in df.columns else F.lit(None).cast("double")
    return [df[id_column].cast("long").alias("doc_id"), df[text_column].alias("text"), meta.alias("meta")]


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "quality",
    folds: int = 5,
    id_column: str = "doc_id",
    text_column: str = "text",
    meta_column: str = "n_chars",
    sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
    rank: int = RANK,
) -> Machine:
    """Fit on at most ``sample_rows`` labelled rows outside fold 0.

    The rows are those whose ids hash lowest, so the sample is the same however
    the tables are stored. Its ids are bounded by the parameter; only they are
    sent to the tasks that read the texts, and one task fits the model on the
    bounded features. Null labels, and labels without a document, teach nothing.
    """
    mark = F.xxhash64(F.lit(11), "_id")
    sample = (
        labels.select(labels["doc_id"].cast("long").alias("_id"), labels[label_column].cast("int").alias("_label"))
        .where("_id is not null and _label is not null")
        .where(fold(F.col("_id")) % folds != 0)
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
        .orderBy(mark, "_id")
        .limit(sample_rows)
    )
    rows = docs.select(*_rows(docs, id_column, text_column, meta_column))
    taught = rows.join(F.broadcast(sample), rows["doc_id"] == sample["_id"]).select("_id", "_label", "text", "meta")

    def featured(batches):
        for batch in slices(batches):
            keys = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True))
            for part, texts in chunks(keys, batch.column(2).to_pylist()):
                found = [features(t, k[2], buckets) for k, t in zip(part, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in part], pa.int64()),
                        pa.array([k[1] for k in part], pa.int32()),
                        pa.array([f[0].tobytes() for f in found], pa.binary()),
                        pa.array([np.array(f[1]).tobytes() for f in found], pa.binary()),
                    ],
                    names=["id", "label", "words", "stats"],
                )

    def fitted(batches):
        held: list[tuple[int, int, bytes, bytes]] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
        held.sort()
        held = held[:sample_rows]
        m = fit(
            [np.frombuffer(h[2], np.int32) for h in held],
            np.array([np.frombuffer(h[3]) for h in held]).reshape(len(held), STATS),
            np.array([h[1] for h in held], float),
            buckets,
            rank,
        )
        parts = [np.array([m.bias]), m.linear, m.factors, m.mean, m.scale]
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()]) for p in parts], names=list("abcde"))

    params = (
        taught.mapInArrow(featured, "id long, label int, words binary, stats binary")
        .repartition(1)  # a shuffle: the texts are still read by all tasks
        .mapInArrow(fitted, ", ".join(f"{c} binary" for c in "abcde"))
    ).first()
    if params is None:
        return fit([], np.zeros((0, STATS)), np.zeros(0), buckets, rank)
    bias, linear, factors, mean, scale = (np.frombuffer(p) for p in params)
    return Machine(float(bias[0]), linear, factors.reshape(-1, rank), mean, scale)


def score(
    docs: DataFrame,
    machine: Machine,
    id_column: str = "doc_id",
    text_column: str = "text",
    meta_column: str = "n_chars",
    folds: int = 5,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Whole texts are scored. A null or empty text has a score too (it has no
    words); a null id is held out; repeated rows are scored each; a null length
    is taken from the text; an empty table gives an empty result. The model's
    size is set by its parameters, so it is sent to the tasks as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            keys = list(zip(range(batch.num_rows), batch.column(2).to_pylist(), strict=True))
            for part, texts in chunks(keys, batch.column(1).to_pylist()):
                found = [features(t, k[1], m.buckets) for k, t in zip(part, texts, strict=True)]
                y = m.scores([f[0] for f in found], np.array([f[1] for f in found]).reshape(len(found), STATS))
                first = part[0][0]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        batch.column(3).slice(first, len(part)),
                        pa.array(y),
                        pa.array((y >= threshold).astype(np.int32)),
                    ],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(
        *_rows(docs, id_column, text_column, meta_column), (fold(docs[id_column]) % folds == 0).alias("held_out")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_rows(
    docs: DataFrame,
    machine: Machine,
    text_column: str = "text",
    meta_column: str = "n_chars",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_column)
    meta_at = docs.columns.index(meta_column) if meta_column in docs.columns else None

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            meta = batch.column(meta_at).to_pylist() if meta_at is not None else [None] * batch.num_rows
            keys = list(enumerate(meta))
            for part, texts in chunks(keys, batch.column(at).to_pylist()):
                found = [features(t, k[1], m.buckets) for k, t in zip(part, texts, strict=True)]
                y = m.scores([f[0] for f in found], np.array([f[1] for f in found]).reshape(len(found), STATS))
                yield batch.slice(part[0][0], len(part)).filter(pa.array(y >= threshold))

    return docs.mapInArrow(run, docs.schema)
