"""Exact grouped medians that do not gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS_PER_UNIT = 1024


def log_bin(value: Column) -> Column:
    """A monotone integer bin of any double: fine around every magnitude."""
    magnitude = F.ln(F.abs(F.nullif(value, F.lit(0.0)))) + F.lit(800.0)
    return F.floor(F.signum(value) * F.coalesce(magnitude, F.lit(0.0)) * F.lit(BINS_PER_UNIT)).cast("long")


def weighted_median(df: DataFrame, group: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Exact median of ``value`` repeated ``weight`` times, per group.

    Step 1 counts rows per ``(group, bin)`` - partial aggregation, and a hot
    group is spread over its bins. Step 2 finds the bin that holds each middle
    rank from the running bin totals (one row per bin). Step 3 orders only the
    values inside those bins. Reads ``df`` twice, so hand in a stored table
    when it is costly.
    """
    keyed = df.select(*group, F.col(value).alias("_v"), F.col(weight).alias("_w"), log_bin(F.col(value)).alias("_bin"))
    bins = keyed.groupBy(*group, "_bin").agg(F.sum("_w").alias("_n"))
    along = W.partitionBy(*group).orderBy("_bin")
    totals = bins.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(*group))
    )
    lo, hi = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    picked = totals.where(holds(lo) | holds(hi)).select(
        *[F.col(c).alias(f"_k_{c}") for c in (*group, "_bin")], "_before", lo.alias("_lo"), hi.alias("_hi")
    )
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*group, "_bin")]
    inside = keyed.join(picked, on, "inner")
    within = W.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside.withColumn("_to", F.col("_before") + F.sum("_w").over(within))
    at = lambda rank: F.max(
        F.when((F.col("_to") - F.col("_w") <= F.col(rank)) & (F.col(rank) < F.col("_to")), F.col("_v"))
    )
    return placed.groupBy(*group).agg(((at("_lo") + at("_hi")) / 2).alias(name))
