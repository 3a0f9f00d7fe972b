"""Repeated lines across documents, found in levelled sorted runs of line hashes.

A run is a table of line keys (two 64-bit hashes) in sorted order with what one
batch of documents knows of each key: in how many documents it stands and, for
keys no earlier run holds, the document that keeps its lines. A batch of
documents is anti-joined with the runs written so far, then becomes a run of
level 0. When a level has ``fan_in`` runs they are merged into one of the next
level. Batches go from the largest ids to the smallest, so the first batch that
holds a key holds its keeper.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANKS, lower_ascii, stored
from ledgerloom.session import shared_dir

KEY = ["h1", "h2"]
LEAST_ID = -(2**63)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def key_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """``doc, h1, h2``: the different long keys of every row's text."""
    keys = F.transform(F.split("text", "\n", -1), line_key)
    long = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    return rows.select("doc", F.explode(F.array_distinct(F.transform(long, hashes))).alias("k")).select(
        "doc", "k.h1", "k.h2"
    )


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))


class LineRuns:
    """The runs of one corpus, by level."""

    def __init__(self, spark, fan_in: int = 4) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, keys: DataFrame) -> None:
        """Anti-join one batch (``doc, h1, h2``, distinct) with the runs and file it as a run.

        Counting is by (key, document) pairs, so a key in a third of all
        documents is combined map-side before any shuffle.
        """
        batch = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
        known = self.all()
        if known is not None:
            seen = known.where("keeper is not null").select(*KEY, F.lit(True).alias("_seen"))
            batch = batch.join(seen, KEY, "left").select(
                *KEY, "docs", F.when(F.col("_seen").isNull(), F.col("keeper")).alias("keeper")
            )
        self._file(batch, 0)

    def _file(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        path = shared_dir(self.spark, f"line-run-{level}")
        run.sortWithinPartitions(*KEY).write.option("compression", "zstd").parquet(path)
        self.levels[level].append(self.spark.read.schema(run.schema).parquet(path))
        if len(self.levels[level]) >= self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._file(merged(reduce(DataFrame.unionByName, full)), level + 1)

    def totals(self) -> DataFrame:
        return merged(self.all())


def id_ranges(rows: DataFrame, batches: int) -> list[Column]:
    """Conditions that split the rows by id into about equal batches, largest ids first."""
    marks = [i / batches for i in range(1, batches)]
    cuts = rows.agg(F.percentile_approx("doc", marks, 1000)).first()[0] if marks else []
    cuts = sorted(set(cuts or []), reverse=True)
    edges = [None, *cuts, None]
    out = []
    for high, low in zip(edges, edges[1:], strict=False):
        inside = F.lit(True)
        if high is not None:
            inside = inside & (F.col("doc") <= high)
        if low is not None:
            inside = inside & (F.col("doc") > low)
        out.append(inside)
    return out


def line_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fan_in: int = 4,
) -> DataFrame:
    """One row per input row: ``doc_id, text`` (the lines kept) ``, n_lines, n_dropped``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys
    of at least ``min_chars`` code points that stand in at least ``min_docs``
    documents lose their lines everywhere except in the largest id that holds
    them. A null or empty text is one empty line. A null id counts as the
    smallest id; rows with equal ids are one document for counting and keeping.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        docs[id_column].alias("doc_id"),
        F.coalesce(docs[id_column].cast("long"), F.lit(LEAST_ID)).alias("doc"),
        F.coalesce(docs[text_column], F.lit("")).alias("text"),
    )
    runs = LineRuns(docs.sparkSession, fan_in)
    for inside in id_ranges(rows, batches):
        runs.add(key_rows(rows.where(inside), min_chars).distinct())
    hot = stored(runs.totals().where(F.col("docs") >= min_docs).select(*KEY, "keeper"), "hot-lines")
    lost = (
        key_rows(rows, min_chars)
        .join(hot, KEY)
        .where("doc <> keeper")
        .groupBy("doc")
        .agg(F.collect_set(F.struct(*KEY)).alias("_lost"))
    )
    lines = F.split("text", "\n", -1)
    stays = F.filter(
        lines,
        lambda x: (F.char_length(line_key(x)) < min_chars) | ~F.array_contains(F.col("_lost"), hashes(line_key(x))),
    )
    found = rows.join(lost, "doc", "left").select(
        "doc_id",
        "text",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("_lost").isNotNull(), stays).alias("_stays"),
    )
    return found.select(
        "doc_id",
        F.coalesce(F.array_join("_stays", "\n"), F.col("text")).alias("text"),
        "n_lines",
        F.coalesce(F.col("n_lines") - F.size("_stays"), F.lit(0)).cast("long").alias("n_dropped"),
    )
