"""Keyed tables and the period-partitioned footprint store."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.identity import KEY_BITS, with_key_bits
from ledgerloom.model import FOOTPRINT, FOOTPRINT_KEY
from ledgerloom.session import materialize, shuffles_freed

# ------------------------------------------------------------- keyed tables


def duplicate_keys(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys a create would clash on: present already, or twice in the batch."""
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    return rows.join(table, list(key), "left_semi").select(*key).unionByName(twice).distinct()


def create_rows(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert; raises when a key exists (checked on keys only)."""
    clash = duplicate_keys(table, rows, key)
    if not clash.isEmpty():
        raise ValueError(f"duplicate key {clash.first().asDict()}")
    return table.unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.unionByName(rows.join(table, list(key), "left_anti"))


def read_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_semi")


def one_per_key(rows: DataFrame, key: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """One row per key of a batch: the greatest by ``first``, then by all other columns.

    The choice depends on the rows alone, so a replay makes the same one, and
    it is combined map-side, so a key that fills the batch is no hot spot.
    """
    values = [c for c in rows.columns if c not in key]
    if not values:
        return rows.distinct()
    order = [*first, *(c for c in values if c not in first)]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in rows.columns])


def update_rows(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace rows that exist; keys without a row are ignored."""
    values = [c for c in table.columns if c not in key]
    rows = one_per_key(rows, key)
    new = rows.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = table.join(new, list(key), "left")
    pick = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values}
    return joined.select(*[pick.get(c, F.col(c)) for c in table.columns])


def upsert_rows(table: DataFrame, rows: DataFrame, key: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Keyed union: a row with a known key replaces the stored one; a key twice in the batch is one row."""
    rows = one_per_key(rows, key, first)
    return table.join(rows, list(key), "left_anti").unionByName(rows)


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def deleted_count(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def find_by(table: DataFrame, column: str, value, criteria: Column | None = None) -> DataFrame:
    """Look-up by a non-key column; the test reaches the parquet scan."""
    hit = table.where(F.col(column) == F.lit(value))
    return hit if criteria is None else hit.where(criteria)


def all_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.select(*key)


def rebuild(table: DataFrame, defaults: Mapping[str, object], transform: Mapping[str, Column] | None = None) -> DataFrame:
    """Bring rows of an older layout to the current one."""
    out = table
    for name, value in defaults.items():
        current = F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(current, F.lit(value)))
    for name, column in (transform or {}).items():
        out = out.withColumn(name, column)
    return out


# ---------------------------------------------------------------- footprints


def footprint_of(txns: DataFrame) -> DataFrame:
    """Minimal record of a committed transaction."""
    return txns.select(
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        "amount_usd",
        "category_id",
        "hash",
        F.col("is_manual").cast("int").alias("is_manual"),
    )


def merge_footprints(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed union: a record with a known key replaces the stored one. Of equal
    keys in one batch (overlapping files) a manual decision stays."""
    return upsert_rows(existing, new, FOOTPRINT_KEY, first=("is_manual",))


def merge_into_store(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``merge_footprints`` where ``existing`` holds a key once, as the store does.

    Stored and new records meet in one aggregation, so they are moved once, and
    their hashes as half as many bytes. Stored records without a whole key
    match nothing and stay.
    """
    whole = F.lit(True)
    for k in FOOTPRINT_KEY:
        whole = whole & F.col(k).isNotNull()
    both = existing.where(whole).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    packed = F.unhex("hash")
    same = F.lower(F.hex(packed)).eqNullSafe(F.col("hash"))
    both = both.withColumns({"_packed": F.when(same, packed), "hash": F.when(~same, F.col("hash"))})
    best = one_per_key(both, [*FOOTPRINT_KEY, "_packed"], first=("_new", "is_manual"))
    best = best.withColumn("hash", F.coalesce(F.lower(F.hex("_packed")), "hash"))
    return existing.where(~whole).unionByName(best.select(*existing.columns))


# The store is a set of month folders and a list of which folder is valid for a
# month. A commit writes its months to folders of its own and then appends one
# file to the list; until that file is there, readers see the state before.
_BATCHES, _LIST = "months", "list"
_LIST_SCHEMA = "version long, year int, month int, batch string"


def _folders(spark: SparkSession, path: str) -> list[Row]:
    """The valid folder of every month: at most twelve rows a year."""
    try:
        listed = spark.read.schema(_LIST_SCHEMA).parquet(f"{path}/{_LIST}")
        return (
            listed.groupBy("year", "month")
            .agg(F.max(F.struct("version", "batch")).alias("m"))
            .select("year", "month", "m.version", "m.batch")
            .collect()
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def read_store(spark: SparkSession, path: str, periods: Iterable[tuple[int, int]] | None = None) -> DataFrame:
    """The store with its fixed schema; an absent store reads as empty.

    With ``periods`` only the folders of those months are read.
    """
    wanted = None if periods is None else set(periods)
    places = [
        f"{path}/{_BATCHES}/batch={m['batch']}/year={m['year']}/month={m['month']}"
        for m in _folders(spark, path)
        if wanted is None or (m["year"], m["month"]) in wanted
    ]
    if not places:
        return spark.createDataFrame([], FOOTPRINT)
    rows = spark.read.schema(FOOTPRINT).option("basePath", f"{path}/{_BATCHES}").parquet(*places)
    return rows.select(*FOOTPRINT.names)


def months_of(rows: DataFrame) -> list[tuple[int, int]]:
    """The months in a batch, a set bounded by the calendar."""
    return [(r["year"], r["month"]) for r in rows.select("year", "month").distinct().collect()]


def of_periods(footprints: DataFrame, wanted: DataFrame, manual_only: bool = False) -> DataFrame:
    """Footprints of the wanted months.

    The months, a set bounded by the calendar, become a filter on the partition
    columns, so the scan reads only their folders.
    """
    rows = footprints.where("is_manual = 1") if manual_only else footprints
    years: dict[int, list[int]] = {}
    for year, month in months_of(wanted):
        years.setdefault(year, []).append(month)
    test = F.lit(False)
    for year, months in sorted(years.items()):
        test = test | ((F.col("year") == year) & F.col("month").isin(sorted(months)))
    return rows.where(test)


def mark_duplicates(txns: DataFrame, existing: DataFrame) -> DataFrame:
    """Flag rows whose key is stored already; copies inside the batch carry
    different hashes and therefore stay new."""
    stored = with_key_bits(existing.dropna(subset=list(FOOTPRINT_KEY)), FOOTPRINT_KEY).select(*KEY_BITS).distinct()
    rows = with_key_bits(txns, FOOTPRINT_KEY).join(stored.withColumn("_stored", F.lit(True)), list(KEY_BITS), "left")
    others = [c for c in txns.columns if c not in (*FOOTPRINT_KEY, "dup")]
    return rows.select(*FOOTPRINT_KEY, *others, F.coalesce("_stored", F.lit(False)).alias("dup"))


#: What a commit reads of a priced transaction.
PRICED = ("date", "currency", "amount_usd", "rate_missing", "category_id", "hash", "is_manual")


class RatesMissing(RuntimeError):
    """A batch holds rows that cannot be valued; nothing was written."""


def put_batch(spark: SparkSession, path: str, new: DataFrame, stored: bool = False) -> None:
    """All-or-nothing upsert of one batch; one writer at a time.

    The batch is read twice; with ``stored`` it comes from a stored frame and is
    not stored anew.

    Only the months of the batch are read and merged. The merged months are
    written to folders of their own and become valid together when the list
    gets its one new file, so a failure in between changes nothing. Rows are
    rebalanced by month, and a large month is written by several tasks. Files
    are sorted by hash and carry a Bloom filter of their hashes, so a look-up by
    hash skips row groups that cannot hold it.
    """
    new = new.select(*FOOTPRINT.names)
    new = new if stored else materialize(new, "batch", compression="zstd")
    periods = months_of(new)
    if not periods:
        return
    merged = merge_into_store(read_store(spark, path, periods), new)
    batch = uuid.uuid4().hex
    placed = merged.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "hash")
    files = placed.write.options(**{"parquet.bloom.filter.enabled#hash": "true", "compression": "zstd"}).partitionBy("year", "month")
    with shuffles_freed(spark):
        files.parquet(f"{path}/{_BATCHES}/batch={batch}")
    version = max((m["version"] for m in _folders(spark, path)), default=0) + 1
    rows = [(version, year, month, batch) for year, month in periods]
    spark.createDataFrame(rows, _LIST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{_LIST}")


def commit(spark: SparkSession, path: str, priced: DataFrame) -> None:
    """Check that every row has a USD value, then write the batch.

    ``priced`` is read by the check and by the write, so it must be stored; it
    needs the columns ``PRICED`` only.
    """
    missing = priced.where("rate_missing").select("currency", "date").limit(1).collect()
    if missing:
        raise RatesMissing(f"no USD rate for {missing[0]['currency']} on {missing[0]['date']}")
    put_batch(spark, path, footprint_of(priced), stored=True)
