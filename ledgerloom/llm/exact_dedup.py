"""Exact duplicates by skew-safe combining.

Equal texts are merged in three steps: inside each map task, then among the
tasks that share a salt, then over all salts. Every step groups by the full
text; the digest only names the group afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

SALTS = 32


def text_groups(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``_digest, _text, keep_id, group_size``: one row per different text.

    The first grouping has the map task's salt in its key, so Spark's map-side
    combine leaves one row per text and task, and a text that fills a third of
    the table meets in ``salts`` reducers. The second merges the salt winners.
    """
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    winners = salted.groupBy("_digest", "_text", "_salt").agg(
        F.max("doc_id").alias("_win"), F.count(F.lit(1)).alias("_rows")
    )
    return winners.groupBy("_digest", "_text").agg(
        F.max("_win").alias("keep_id"), F.sum("_rows").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text: Column | str = "text", salts: int = SALTS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. A null text counts as
    empty. A null id is smaller than any other and stays only when the whole
    group has none. Rows that repeat both id and text are one document seen
    again: exactly one of them is kept. Other columns are ignored, whatever
    their names; an empty table gives an empty result.

    The digest is proven to name one text only by the groups themselves: should
    two texts share one, their rows are matched by the text as well.
    """
    body = docs[text] if isinstance(text, str) else text
    rows = named(docs.select(docs[id_column].alias("doc_id"), body.alias("_text")))
    groups, clashing = digest_groups(rows, salts)
    once = rows.select(
        "doc_id",
        "_digest",
        F.row_number().over(W.partitionBy("_digest", "doc_id").orderBy(F.lit(0))).alias("_copy"),
    )
    if clashing is None:
        found = once.join(groups, "_digest")
    else:
        found = by_text(rows, clashing, salts).unionByName(
            once.join(clashing, "_digest", "left_anti").join(groups, "_digest")
        )
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_text`` never null, and its ``_digest``."""
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    return rows.withColumn("_text", text).withColumn("_digest", F.unhex(F.sha2("_text", 256)))


def digest_groups(rows: DataFrame, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """The groups by digest, stored, and the digests of several texts (None where there are none)."""
    groups = stored(text_groups(rows, salts).drop("_text"), "text-groups")
    clashing = groups.groupBy("_digest").count().where("count > 1").select("_digest")
    return groups, None if clashing.isEmpty() else clashing


def without_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Whole rows meet their group by digest and id together, so a large group
    has one row per key.
    """
    columns = [docs[c].alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    rows = named(docs.select(docs[id_column].alias("doc_id"), docs[text].alias("_text"), *columns))
    groups, clashing = digest_groups(rows.select("doc_id", "_text", "_digest"), salts)
    stay = groups.select(F.col("_digest").alias("_d"), F.col("keep_id").alias("_k"))
    same = (F.col("_digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_k"))
    key = ["_digest", "doc_id"]
    if clashing is not None:
        stay = text_groups(rows, salts).select(
            F.col("_digest").alias("_d"), F.col("keep_id").alias("_k"), F.col("_text").alias("_t")
        )
        same, key = same & (F.col("_text") == F.col("_t")), [*key, "_text"]
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    kept = rows.join(stay, same).withColumn("_copy", first).where("_copy = 1")
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def by_text(rows: DataFrame, clashing: DataFrame, salts: int) -> DataFrame:
    """The rows whose digest stands for several texts, matched by the texts."""
    unclear = rows.join(clashing, "_digest", "left_semi")
    copy = F.row_number().over(W.partitionBy("_digest", "doc_id", "_text").orderBy(F.lit(0)))
    return (
        unclear.withColumn("_copy", copy)
        .join(text_groups(unclear, salts), ["_digest", "_text"])
        .select("doc_id", "_digest", "_copy", "keep_id", "group_size")
    )
