"""Reading the given tables with a stable source position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import materialize


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by ``keys`` where they are read in fewer tasks than there are cores.

    A small table in one piece would otherwise keep all work of its rows in one
    task; a table of many pieces is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_with_position(spark: SparkSession, folder: str, name: str, position: str = "src_row") -> DataFrame:
    """A parquet table with the physical row position of every row.

    The position comes from the parquet reader (no sort, no shuffle) and is the
    same on every recomputation. With several files the row counts of the
    earlier files are added; that side has one row per file.
    """
    df = read_table(spark, folder, name)
    row = F.col("_metadata.row_index")
    if len(df.inputFiles()) <= 1:
        return spread(df.select("*", row.cast("long").alias(position)), position)
    located = df.select("*", row.cast("long").alias("_row"), F.col("_metadata.file_path").alias("_file"))
    sizes = df.select(row.alias("_row"), F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        (F.max("_row") + 1).alias("_size")
    )
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # stored, Spark knows how small it is and does not move the table's rows to meet it
    starts = materialize(starts, "starts")
    return (
        located.join(starts, "_file")
        .withColumn(position, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_file", "_row", "_start")
    )
