"""Rate tables: reading, merging and planning what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_key

FIRST_RATE_DAY = "1999-01-01"


def long_rates(tables: DataFrame) -> DataFrame:
    """``(base, date, quotes map<string,string>)`` to one row per quote."""
    return (
        tables.select("base", "date", F.explode("quotes").alias("ccy", "text"))
        .where(~F.col("ccy").isin("base", "date"))
        .select("base", "date", "ccy", F.col("text").try_cast("double").alias("rate"))
    )


def long_from_columns(wide: DataFrame) -> DataFrame:
    """The same for tables that have one column per currency."""
    codes = [c for c in wide.columns if c not in ("base", "date")]
    texts = wide.select("base", "date", *[F.col(c).cast("string").alias(c) for c in codes])
    return texts.unpivot(["base", "date"], codes, "ccy", "text").where("text is not null").select(
        "base", "date", "ccy", F.col("text").try_cast("double").alias("rate")
    )


def rates_for_dates(rates: DataFrame, dates: DataFrame, base: str) -> DataFrame:
    """Quotes of the requested days; days without a table are left out."""
    return rates.where(F.col("base") == base).join(dates.select("date").distinct(), "date", "left_semi")


def merge_rates(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched quotes over stored ones, one row per base, date and currency."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(fetched.withColumn("_age", F.lit(1)))
    newest = both.groupBy("base", "date", "ccy").agg(F.max_by("rate", "_age").alias("rate"))
    return newest


def write_rates(rates: DataFrame, path: str) -> None:
    """Month-partitioned sink; only the months at hand are replaced."""
    (
        rates.withColumn("month", month_key(F.col("date")))
        .repartition("month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def requestable(text: Column, today: Column) -> Column:
    """ISO day texts from 1999 up to today."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.between(F.lit(FIRST_RATE_DAY), today)


def backfill_plan(requested: DataFrame, rates: DataFrame, base: str, cap: int, used: int) -> DataFrame:
    """Earliest missing days that still fit the monthly budget.

    Top-k over distinct days: partial per task, so nothing is gathered but
    the k days asked for.
    """
    known = rates.where(F.col("base") == base).select("date").distinct()
    missing = requested.select("date").distinct().join(known, "date", "left_anti")
    return missing.orderBy("date").limit(max(0, cap - used))


def backfill_summary(requested: DataFrame, rates: DataFrame, base: str, cap: int, used: int) -> DataFrame:
    known = rates.where(F.col("base") == base).select("date").distinct().withColumn("_known", F.lit(True))
    days = requested.select("date").distinct().join(known, "date", "left")
    misses = F.count_if(F.col("_known").isNull())
    allowed = F.greatest(F.lit(0), F.least(misses, F.lit(cap - used)))
    return days.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("_known").alias("cached"),
        allowed.cast("long").alias("allowed"),
        (misses - allowed).cast("long").alias("cap_cut"),
    )


def monthly_usage(fetches: DataFrame, day: str = "date") -> DataFrame:
    return fetches.groupBy(month_key(F.col(day)).alias("month_key")).agg(F.count(F.lit(1)).alias("used"))


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last write per key."""
    newest = W.partitionBy(*key).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
