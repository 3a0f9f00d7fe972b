"""Exact top-k search of queries over documents by vector length.

A document is the vector of its impacts on the terms that queries use; a
query's score is the sum of its terms' impacts. Documents are ordered by the
length of their vectors (norm) and searched in buckets of similar length:

* Cauchy-Schwarz: no score in a bucket exceeds the query's norm times the
  greatest norm of the bucket; a query skips buckets below its threshold;
* inside a bucket the greatest value of each coordinate bounds what the terms of
  low weight can still add. Only the terms before that point (the focus) are
  added up; a document stays if its sum, with what the coordinate bounds and
  Cauchy-Schwarz over the rest of its vector allow, can reach the threshold;
* what stays is scored again exactly in 64-bit integers.

A query's threshold is its k-th best score so far. The longest vectors are
searched first, in a job of their own, which gives every later task a threshold
to begin with; ties are kept until the end, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import slices
from ledgerloom.llm.common import UPPER, scan_partitions, stored
from ledgerloom.llm.decontaminate import item_blocks

#: Characters of queries searched in one pass; it bounds the vocabulary that tasks hold.
BLOCK_CHARS = 2_000_000
BUCKET_ROWS = 1024
#: The share of the rows, those with the longest vectors, that is searched first.
FIRST_SHARE = 1 / 64
MARGIN = 1e-9

#: Bytes of terms, A-Z lower-cased; all other ASCII bytes separate them.
TERM_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or "").encode().translate(TERM_BYTES).split()


class Queries:
    """A block of queries as lists of term numbers, most weighty terms first."""

    def __init__(self, block: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in block]
        each = [list(dict.fromkeys(terms(t))) for _, t in block]
        self.vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for ts in each for t in ts))}
        self.terms = [np.array([self.vocabulary[t] for t in ts], np.int64) for ts in each]

    def weigh(self, df: np.ndarray, n_docs: int) -> np.ndarray:
        """Each term's integer weight; the queries' terms are ordered by it."""
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in df.tolist()], np.int64)
        self.terms = [ts[np.argsort(-weights[ts], kind="stable")] for ts in self.terms]
        self.flat = np.concatenate(self.terms) if self.terms else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(ts) for ts in self.terms])]).astype(np.int64)
        return weights


COUNTS = "doc_id long, n long, terms binary, tfs binary, term long, df long"
VECTORS = "doc_id long, norm double, m long, terms binary, tfs binary"
DOCS, TOKENS = -1, -2


def counted(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Each text's counts of the vocabulary's terms, packed, and after them each task's own statistics."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary()), ("term", pa.int64()), ("df", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        docs = tokens = 0
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = terms(text)
                if not words:
                    continue
                docs, tokens = docs + 1, tokens + len(words)
                held = Counter(map(vocabulary.get, words))
                held.pop(None, None)
                if held:
                    numbers = np.fromiter(held.keys(), "<u4", len(held))
                    df[numbers] += 1
                    out.append((doc_id, len(words), numbers.tobytes(), np.fromiter(held.values(), "<u4", len(held)).tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            blank = [None] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, blank, blank], schema, strict=True)], schema=schema)
        seen = np.flatnonzero(df)
        facts = [[*seen.tolist(), DOCS, TOKENS], [*df[seen].tolist(), docs, tokens]]
        blank = [None] * (len(seen) + 2)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([blank] * 4 + facts, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, COUNTS)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed 32-bit numbers of several rows in one array, and each row's number of them."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), "<u4").astype(np.int64), np.array([len(h) // 4 for h in held], np.int64)


def impacts(weights: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_tokens: int) -> DataFrame:
    """The documents' vectors with their norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_000):
            if not batch.num_rows:
                continue
            (term, sizes), (tf, _) = unpacked(batch.column(2)), unpacked(batch.column(3))
            m = np.array([100 - 90 + 90 * n * n_docs // n_tokens for n in batch.column(1).to_pylist()], np.int64)
            value = impacts(weights, term, tf, np.repeat(m, sizes)).astype(float)
            norm = np.sqrt(np.add.reduceat(value * value, np.cumsum(sizes) - sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(norm), pa.array(m), batch.column(2), batch.column(3)],
                names=["doc_id", "norm", "m", "terms", "tfs"],
            )

    return counts.where("terms is not null").select("doc_id", "n", "terms", "tfs").mapInArrow(run, VECTORS)


class Bucket:
    """Vectors of similar length by row and by coordinate."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, queries: Queries) -> None:
        self.rows = batch.num_rows
        ids = batch.column(0)
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        (term, sizes), (tf, _) = unpacked(batch.column(3)), unpacked(batch.column(4))
        row = np.repeat(np.arange(self.rows), sizes)
        value = impacts(weights, term, tf, batch.column(2).to_numpy()[row])
        order = np.argsort(term, kind="stable")
        self.row, self.value = row[order], value[order]
        self.squared = np.bincount(row, value.astype(float) ** 2, minlength=self.rows)
        self.norm = math.sqrt(self.squared.max())
        held, at = np.unique(term[order], return_index=True)
        top = np.maximum.reduceat(self.value, at)
        place = np.minimum(np.searchsorted(held, queries.flat), len(held) - 1)
        there = held[place] == queries.flat
        ends = np.append(at, len(term))
        self.begin = np.where(there, ends[place], 0)
        self.end = np.where(there, ends[place + 1], 0)
        self.top = np.where(there, top[place], 0)

    def postings(self, first: int, last: int) -> np.ndarray:
        """The places of the entries of coordinates ``first`` to ``last`` of the block's flat list."""
        spans = [np.arange(b, e) for b, e in zip(self.begin[first:last].tolist(), self.end[first:last].tolist(), strict=True) if b < e]
        return np.concatenate(spans) if spans else np.zeros(0, np.int64)

    def survivors(self, first: int, last: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score over the coordinates reaches the threshold, and these scores."""
        none = np.zeros(0, np.int64)
        if math.sqrt(last - first) * self.norm * (1 + MARGIN) < threshold:
            return none, none
        rest = np.append(np.cumsum(self.top[first:last][::-1])[::-1], 0)
        focus = int(np.argmax(rest < threshold))  # coordinates from here on cannot reach it alone
        if not focus:
            return none, none
        at = self.postings(first, first + focus)
        row, value = self.row[at], self.value[at].astype(float)
        reached = np.bincount(row, value, minlength=self.rows)
        unseen = np.maximum(self.squared * (1 + MARGIN) - np.bincount(row, value * value, minlength=self.rows), 0)
        allowed = np.minimum(rest[focus], np.sqrt((last - first - focus) * unseen))
        stays = (reached > 0) & ((reached + allowed) * (1 + MARGIN) + 1 >= threshold)
        if not stays.any():
            return none, none
        more = self.postings(first + focus, last)
        at = np.concatenate([at, more[stays[self.row[more]]]]) if len(more) else at
        score = np.zeros(self.rows, np.int64)
        np.add.at(score, self.row[at], self.value[at])
        rows = np.flatnonzero(stays & (score >= threshold))
        return rows, score[rows]


def best(index: DataFrame, queries: Queries, weights: np.ndarray, k: int, thresholds: np.ndarray) -> DataFrame:
    """Each task's k best rows for every query whose scores reach the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = thresholds.copy()
        found: dict[int, tuple] = {}
        for batch in slices(batches, BUCKET_ROWS):
            if not batch.num_rows:
                continue
            bucket = Bucket(batch, weights, queries)
            for q in range(len(queries.ids)):
                rows, scores = bucket.survivors(int(queries.at[q]), int(queries.at[q + 1]), int(least[q]))
                if not len(rows):
                    continue
                new = (scores, bucket.missing[rows], bucket.ids[rows])
                held = tuple(map(np.concatenate, zip(found[q], new, strict=True))) if q in found else new
                turn = np.lexsort((held[2], held[1], -held[0]))[:k]
                found[q] = tuple(h[turn] for h in held)
                if len(turn) == k:
                    least[q] = max(least[q], found[q][0][-1])
        out = [(q, None if gone else i, s) for q, held in found.items() for s, gone, i in zip(*map(np.ndarray.tolist, held), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def top_k(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Each item's ``k`` best documents: ``item_id, rank, doc_id, score``.

    A term weighs floor(1000 ln((2N+2)/(2 df+1))); a document's score sums
    weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms,
    where m = 10 + (90 n N) div L for its n terms. Only scores above 0 count;
    equal ones rank by document id, a null id last. Null and empty texts have
    no terms and count nowhere; items without terms have no rows; repeated
    documents and repeated items are ranked each; other columns are ignored;
    empty tables give an empty result. Items are searched in blocks of
    ``block_chars`` characters, each in a pass over all documents, so what
    tasks hold of them is bounded; ``docs`` may grow without bound.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    wanted = items.select(items[item_column].cast("long"), items[item_text]).where(F.col(item_text).isNotNull())
    found: list[DataFrame] = []
    for block in item_blocks(wanted, block_chars):
        queries = Queries(block)
        if queries.vocabulary:
            found.append(searched(rows, queries, k, scan_partitions(docs)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def searched(rows: DataFrame, queries: Queries, k: int, parts: int) -> DataFrame:
    """The ranked rows of one block of queries."""
    spark = rows.sparkSession
    counts = stored(counted(rows, queries.vocabulary), "search-counts")
    facts = dict(counts.where("term is not null").groupBy("term").agg(F.sum("df")).collect())  # a row a term of the block
    n_docs, n_tokens = facts.get(DOCS, 0), facts.get(TOKENS, 0)
    weights = queries.weigh(np.array([facts.get(t, 0) for t in range(len(queries.vocabulary))]), n_docs)

    ordered = vectors(counts, weights, n_docs, max(1, n_tokens)).withColumn("row", F.monotonically_increasing_id())
    keys = [F.col("norm").desc(), F.col("doc_id"), F.col("row")]  # many rows may have one norm, or be one row repeated
    index = stored(ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("row"), "search-index")

    thresholds = np.ones(len(queries.ids), np.int64)
    cut = index.agg(F.percentile_approx("norm", 1 - FIRST_SHARE)).first()[0]
    if cut is not None:
        first = best(index.where(F.col("norm") >= cut), queries, weights, k, thresholds)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
        for q, score in first.withColumn("place", place).where(F.col("place") == k).select("query", "score").collect():
            thresholds[q] = max(1, score)  # a row a query of the block

    hits = best(index, queries, weights, k, thresholds)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
