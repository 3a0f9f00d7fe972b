"""Typed cells: the sixteen column transforms and the column error gate.

Rows keep their cells as one array and every file carries one array of column
descriptions, so parsing is a projection: no row is exploded into cells and
pivoted back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom.functions.currency import get, lookup_maps
from ledgerloom.functions.dates import parse_date_by
from ledgerloom.functions.numbers import parse_number
from ledgerloom.functions.text import empty_to_null, is_null_like, let, trimmed
from ledgerloom.session import materialize

COLUMN_FIELDS = (
    "col_id", "name", "definition", "date_format", "amount_type",
    "currency_mode", "currency_code", "success_value", "recall_state",
)


def file_columns(mapping: DataFrame) -> DataFrame:
    """One row per file: its column descriptions in column order."""
    item = F.struct(*COLUMN_FIELDS)
    return mapping.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("cols"))


def _cell(text=None, number=None, date=None, error=None, ignore=None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if text is None else text).cast("string").alias("text"),
        (none if number is None else number).cast("double").alias("number"),
        (none if date is None else date).cast("date").alias("date"),
        (none if error is None else error).cast("string").alias("error"),
        (none if ignore is None else ignore).cast("string").alias("ignore"),
    )


def as_date(raw: Column, fmt: Column) -> Column:
    return let(
        parse_date_by(raw, fmt), lambda v: _cell(date=v, error=F.when(v.isNull(), F.lit("date-parse-failed")))
    )


def as_amount(raw: Column, kind: Column) -> Column:
    """Outcomes are kept unsigned; income and zero are labelled, not lost."""

    def build(value: Column) -> Column:
        ignore = (
            F.when(kind == "income", "income-value-ignored")
            .when(value == 0, "zero-value-ignored")
            .when((kind == "mixed") & (value > 0), "positive-value-ignored")
        )
        return _cell(
            number=F.when(kind.isin("outcome", "mixed"), F.abs(value)).otherwise(value),
            error=F.when(value.isNull(), "amount-parse-failed"),
            ignore=F.when(value.isNotNull(), ignore),
        )

    return let(parse_number(raw), build)


def as_currency(raw: Column, maps: dict | None = None) -> Column:
    """Alphabetic code, then numeric code, then symbol unless ambiguous."""
    maps = maps or lookup_maps()
    whole = lambda n: get(maps["numeric"], F.when(n == F.floor(n), F.floor(n).cast("string")))

    def build(text: Column) -> Column:
        ambiguous = get(maps["ambiguous"], text).isNotNull()
        code = F.coalesce(
            get(maps["code"], F.upper(text)),
            let(parse_number(text), whole),
            F.when(~ambiguous, get(maps["symbol"], text)),
        )
        reason = F.when(ambiguous, "currency-ambiguous").otherwise("currency-parse-failed")
        return let(code, lambda c: _cell(text=c, error=F.when(c.isNull(), reason)))

    return let(trimmed(raw), build)


def as_text(raw: Column) -> Column:
    return _cell(text=empty_to_null(raw))


def as_number(raw: Column) -> Column:
    """Null-like texts are empty cells, anything else must be a number."""

    def build(empty: Column) -> Column:
        return let(
            F.when(~empty, parse_number(raw)),
            lambda v: _cell(number=v, error=F.when(v.isNull() & ~empty, "number-parse-failed")),
        )

    return let(is_null_like(raw), build)


def as_status(raw: Column, success: Column) -> Column:
    return _cell(text=raw, ignore=F.when(~raw.eqNullSafe(success), "status-value-ignored"))


def as_merchant(raw: Column) -> Column:
    ok = lambda text: F.when(text.rlike(r"^\d{1,4}$"), F.lpad(text, 4, "0"))
    return let(
        let(trimmed(raw), ok), lambda v: _cell(text=v, error=F.when(v.isNull(), "merchant-parse-failed"))
    )


def parse_cell(raw: Column, col: Column, currencies: dict | None = None) -> Column:
    """Dispatch on the column's definition; dropped columns yield empty cells."""
    d = col["definition"]
    return (
        F.when(d == m.DATE, as_date(raw, col["date_format"]))
        .when(d == m.AMOUNT, as_amount(raw, col["amount_type"]))
        .when(d == m.CURRENCY, as_currency(raw, currencies))
        .when(d.isin(*m.TEXT_DEFINITIONS), as_text(raw))
        .when(d.isin(*m.NUMBER_DEFINITIONS), as_number(raw))
        .when(d == m.STATUS, as_status(raw, col["success_value"]))
        .when(d == m.MERCHANT_CATEGORY, as_merchant(raw))
        .otherwise(_cell())
    )


def typed_rows(rows: DataFrame, columns: DataFrame, currencies: dict | None = None) -> DataFrame:
    """Add ``typed``: ``struct<col_id, definition, raw, v>`` per described
    column; ``v`` holds text, number, date, error and ignore. Describe only the
    columns that are needed: no other cell is parsed.

    ``rows(file_id, ..., cells)`` meets its file's column list once. Cells
    beyond the described columns are not mapped and stay raw. ``currencies``
    is ``lookup_maps`` of a fuller list (``frame_maps`` reads it from a table).

    Many files share a column list. The rows meet a digest per file, then the
    different lists by that digest; both tables are stored, so Spark knows how
    small they are and need not move the rows to meet them.
    """
    about = [c for c in columns.columns if c != "file_id"]
    layout = F.sha2(F.to_json(F.struct(*about)), 256)
    known = materialize(columns.withColumn("_layout", layout), "columns")
    lists = materialize(known.select("_layout", *about).distinct(), "layouts")
    files = materialize(known.select("file_id", "_layout"), "file-layouts")
    joined = rows.join(files, "file_id").join(lists, "_layout").select("file_id", *(c for c in rows.columns if c != "file_id"), *about)

    def one(col: Column) -> Column:
        raw = F.get("cells", col["col_id"])
        return F.struct(
            col["col_id"].alias("col_id"),
            col["definition"].alias("definition"),
            raw.alias("raw"),
            parse_cell(raw, col, currencies).alias("v"),
        )

    return joined.withColumn("typed", F.transform("cols", one))


def column_errors(typed: DataFrame, limit: float = m.MAX_COLUMN_ERROR_RATIO) -> DataFrame:
    """Error share per column; a column above the limit is rejected.

    TIME columns hold no cells and therefore never fail.
    """
    cells = typed.select("file_id", F.explode("typed").alias("c"))
    return (
        cells.groupBy("file_id", F.col("c.col_id").alias("col_id"), F.col("c.definition").alias("definition"))
        .agg(F.count(F.lit(1)).alias("total"), F.count("c.v.error").alias("errors"))
        .withColumn("error_ratio", F.col("errors") / F.col("total"))
        .withColumn("rejected", F.col("error_ratio") > limit)
    )


def rejection_details(typed: DataFrame, gate: DataFrame) -> DataFrame:
    """Every cell error of the rejected columns."""
    bad = gate.where("rejected").select("file_id", "col_id")
    cells = typed.select("file_id", "row_index", F.explode("typed").alias("c")).select(
        "file_id", "row_index", "c.col_id", "c.raw", "c.v.error"
    )
    return cells.where("error is not null").join(bad, ["file_id", "col_id"], "left_semi")


def without_rejected(mapping: DataFrame, gate: DataFrame) -> DataFrame:
    """Rejected columns fall back to unmapped."""
    bad = gate.where("rejected").select("file_id", "col_id", F.lit(True).alias("_bad"))
    return (
        mapping.join(bad, ["file_id", "col_id"], "left")
        .withColumn("definition", F.when(F.col("_bad").isNull(), F.col("definition")))
        .drop("_bad")
    )


def unmapped_columns(mapping: DataFrame) -> DataFrame:
    """Columns without a definition; they block generation for their file."""
    return mapping.where(F.col("definition").isNull()).select("file_id", "col_id", "name")


def reset_column(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """Undo a mapping: the raw cells are untouched, so only the entry changes."""
    undo = columns.select("file_id", "col_id", F.lit(True).alias("_undo"))
    joined = mapping.join(undo, ["file_id", "col_id"], "left")
    keep = F.col("_undo").isNull()
    cleared = [F.when(keep, F.col(c)).alias(c) for c in COLUMN_FIELDS if c not in ("col_id", "name")]
    return joined.select("file_id", "col_id", "name", *cleared)
