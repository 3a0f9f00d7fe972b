"""Dense numbering and evenly spaced sampling without one-task groups.

A plain ``row_number`` over a file would sort the whole file in one task. Here
rows carry a *block* (a bounded stretch of source positions): rows are numbered
inside ``(group, block)`` and shifted by the rows of the earlier blocks. The
running total only ever sees one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(position / F.lit(rows)).cast("long")


def _shifted(df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], name: str) -> DataFrame:
    """The start of a block travels as one more row of it, so rows are moved once and meet no table."""
    keys = (*group, block)
    running = W.partitionBy(*group).orderBy(block)
    before = F.sum("_n").over(running.rowsBetween(W.unboundedPreceding, -1))
    # Only groups that span blocks have a start other than zero.
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", before).where("_start > 0")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in keys]
    both = df.withColumn("_start", F.lit(None).cast("long")).unionByName(starts.select(*keys, *none, "_start"))
    placed = W.partitionBy(*keys).orderBy(F.col("_start").desc_nulls_last(), *order)
    reached = F.sum(F.coalesce("_start", F.lit(1))).over(placed.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn(name, reached - 1).where("_start is null").select(*df.columns, name)


def dense_index(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """0-based dense position of each row within ``group`` in source order.

    ``block`` must grow with ``order``.
    """
    return _shifted(df, group, block, order, name)


def occurrence_number(
    df: DataFrame, group: Sequence[str], block: str, order: Sequence[str], name: str = "dup"
) -> DataFrame:
    """0-based number of a row among the rows equal in ``group``.

    Groups that live in one block need no shift, so only those that span
    blocks get a start.
    """
    return _shifted(df, group, block, order, name)


def sample_size(total: Column, percent: float = 10.0, at_least: int = 100, at_most: int = 1000) -> Column:
    wanted = F.least(F.ceil(total * F.lit(percent) / F.lit(100.0)), F.lit(at_most))
    return F.least(total, F.greatest(wanted, F.least(total, F.lit(at_least)))).cast("long")


def in_even_sample(index: Column, total: Column, size: Column) -> Column:
    """True for the ``size`` positions ``floor(i * total / size)``.

    Solved for ``i`` so no index list has to be built or joined.
    """
    i = F.ceil(index * size / total)
    return (i < size) & (F.floor(i * total / size) == index)
