"""Remembered column mappings: recall, collisions, confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_key
from ledgerloom.sources.rates import latest


def with_key(headers: DataFrame, name: str = "name") -> DataFrame:
    """Normalised key per header; the UDF sees distinct names only."""
    keys = headers.select(name).distinct().withColumn("key", normalize_key(F.col(name)))
    return headers.join(keys, name)


def recall(headers: DataFrame, pool: DataFrame) -> DataFrame:
    """Prefill headers from the pool: ``recall_state`` is guessed or null."""
    found = pool.select(F.col("column_name").alias("key"), "definition", "params")
    return with_key(headers).join(found, "key", "left").withColumn(
        "recall_state", F.when(F.col("definition").isNotNull(), F.lit("guessed"))
    )


def recognized(recalled: DataFrame) -> DataFrame:
    """N of M columns per file. N counts distinct keys, M all columns."""
    return recalled.groupBy("file_id").agg(
        F.count_distinct(F.when(F.col("recall_state").isNotNull(), F.col("key"))).alias("recognized"),
        F.count(F.lit(1)).alias("columns"),
    )


def collisions(incoming: DataFrame, pool: DataFrame) -> DataFrame:
    """Same key, other definition or other parameters."""
    old = pool.select(F.col("column_name").alias("key"), F.col("definition").alias("old_definition"), F.col("params").alias("old_params"))
    kind = F.when(F.col("definition") != F.col("old_definition"), "type-change").when(
        ~F.col("params").eqNullSafe(F.col("old_params")), "params-change"
    )
    return incoming.join(old, "key").withColumn("collision", kind).where("collision is not null")


def save_new(pool: DataFrame, incoming: DataFrame) -> DataFrame:
    """Remember unknown keys; known ones are never overwritten here.

    Of several definitions of one key the first in text order is saved;
    ``conflicts`` reports such keys.
    """
    named = incoming.select(F.col("key").alias("column_name"), "definition", "params")
    fresh = named.groupBy("column_name").agg(F.min(F.struct("definition", "params")).alias("d"))
    fresh = fresh.select("column_name", "d.definition", "d.params")
    return pool.unionByName(fresh.join(pool, "column_name", "left_anti"))


def conflicts(incoming: DataFrame) -> DataFrame:
    """Keys that come with more than one definition, and how many."""
    n = F.count_distinct(F.struct("definition", "params"))
    return incoming.groupBy("key").agg(n.alias("definitions")).where("definitions > 1")


def confirm(pool: DataFrame, writes: DataFrame) -> DataFrame:
    """Last confirmed write per key wins over the pool."""
    newest = latest(writes, ["column_name"], "updated_at").drop("updated_at")
    return pool.join(newest, "column_name", "left_anti").unionByName(newest)
