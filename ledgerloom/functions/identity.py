"""Row identity: canonical text, base hash, duplicate-aware final hash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.indexing import occurrence_number
from ledgerloom.functions.text import let
from ledgerloom.session import materialize

# The mapped fields that identify a transaction, in recipe order.
IDENTITY_FIELDS = (
    "date",
    "amount",
    "description",
    "counterparty",
    "currency",
    "balance",
    "account",
    "mcc",
    "exchange_rate",
)
NULL_MARK = "~"


def number_text(c: Column) -> Column:
    """A text form that does not depend on a float printer.

    Numbers that ten places and 28 digits before them cannot hold keep their
    own text, so one huge cell does not end the job.
    """
    return F.coalesce(c.try_cast("decimal(38,10)").cast("string"), c.cast("string"))


def many_text(values: Column) -> Column:
    """Several columns of one definition: their texts sorted, null when none."""
    joined = lambda v: F.when(F.size(v) > 0, F.array_join(F.array_sort(v), "\u001e", NULL_MARK))
    return let(values, joined)


def canonical_text(texts: Mapping[str, Column], kind: Column) -> Column:
    """``name=length:value`` per field; the length makes it unambiguous."""
    parts: list[Column] = []
    for field in IDENTITY_FIELDS:
        body = F.lit(NULL_MARK)
        if field in texts:
            text = texts[field]
            body = F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), body)
        parts.append(F.concat(F.lit(f"{field}="), body))
    parts.append(F.concat(F.lit("kind="), kind))
    return F.concat_ws(";", *parts)


def field_texts(df: DataFrame, present: Sequence[str] = IDENTITY_FIELDS) -> dict[str, Column]:
    """Canonical texts of a frame whose columns are named like the fields."""
    types = dict(df.dtypes)
    return {
        f: number_text(F.col(f)) if types[f] == "double" else F.col(f).cast("string") for f in present if f in types
    }


def base_hash(texts: Mapping[str, Column], kind: Column) -> Column:
    return F.sha2(canonical_text(texts, kind), 256)


def final_hash(base: Column, dup: Column) -> Column:
    return F.sha2(F.concat(base, F.lit("#"), dup.cast("string")), 256)


KEY_BITS = ("_bits_a", "_bits_b")


def with_key_bits(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """128 bits of a key, which a join moves instead of the key's texts.

    Nulls add nothing to the bits: a side must leave out keys with a null, for
    which rows of the other side would else be no match in a join on the key.
    """
    texts = [F.col(k).cast("string") for k in key]
    return df.withColumns(dict(zip(KEY_BITS, (F.xxhash64(*texts), F.xxhash64(F.lit("b"), *texts)), strict=True)))


def with_final_hash(
    df: DataFrame, batch: str = "file_id", order: Sequence[str] = ("row_index",), block: str = "row_block"
) -> DataFrame:
    """Give identical rows of one batch distinct, replay-stable hashes.

    The k-th copy of a base hash inside a batch gets ``sha(base#k)``. The
    counter runs per batch, never per micro-batch, so an import can be
    replayed; copies are numbered block by block, so a base hash that holds a
    third of all rows is still numbered by many tasks.

    Only rows with copies are moved to be numbered. They are found by a stored
    count over 64 bits of their key; a count too high by chance moves a row that
    has no copy and gives it the same number.
    """
    keyed = df.withColumn("_copies", F.xxhash64(batch, "base_hash"))
    repeated = keyed.groupBy("_copies").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_copies")
    repeated = materialize(repeated, "repeated")
    alone = keyed.join(repeated, "_copies", "left_anti").select(*df.columns, F.lit(0).cast("long").alias("dup"))
    copies = keyed.join(repeated, "_copies", "left_semi").select(*df.columns)
    numbered = alone.unionByName(occurrence_number(copies, [batch, "base_hash"], block, order, "dup"))
    return numbered.withColumn("hash", final_hash(F.col("base_hash"), F.col("dup")))
