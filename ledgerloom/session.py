"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Dates are calendar days, so the session zone is pinned to UTC. AQE picks
    the reducer count and splits skewed joins from run-time sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # no call site for each column expression: plans are built several times faster
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: All folders of one run lie in one folder, so that they can be removed together.
RUN = uuid.uuid4().hex


@cache
def _local_root() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="ledgerloom-")


def shared_root(spark: SparkSession) -> str:
    """The folder of this run below the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir``. A session that runs in
    one machine's single process (tests, the bench) may leave it unset and gets
    a folder that goes when the process ends; on a cluster it must be set,
    since no executor would see another one's local files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "") or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root().name
    return os.path.join(root, "ledgerloom", RUN)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in this run's shared folder."""
    return os.path.join(shared_root(spark), f"{purpose}-{uuid.uuid4().hex}")


def clear_shared(spark: SparkSession) -> None:
    """Remove all that this run has stored; frames that still read it are lost."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(shared_root(spark))
    if system.get_file_info(place).type != fs.FileType.NotFound:
        system.delete_dir(place)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write go as soon as it ends: what it wrote is read instead of them."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def materialize(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    ``options`` go to the writer; rows with hashes or texts are smaller by half with
    ``compression="zstd"``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    with shuffles_freed(spark):
        df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
