"""Typed rows to transactions: amount and currency choice, pseudo operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom.functions.currency import symbol_to_iso
from ledgerloom.functions.identity import NULL_MARK, base_hash, many_text, number_text, with_final_hash
from ledgerloom.functions.indexing import dense_index

COMMISSION_LABEL = "Bank commission"
CASHBACK_LABEL = "Cashback"
KINDS = ("main", "commission", "cashback")


def _of(definition: str, source: str = "cols") -> Column:
    return F.filter(source, lambda c: c["definition"] == definition)


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


# ----------------------------------------------------- per-file choices (B25/26)


def with_amount_choice(columns: DataFrame, base_currency: str) -> DataFrame:
    """Which AMOUNT column counts and where its currency comes from.

    Decided once per file from the mapping: adds ``amount_col``,
    ``currency_col`` (null for a fixed currency), ``currency_fixed`` and
    ``choice_error``.
    """
    amounts, currencies = _of(m.AMOUNT), _of(m.CURRENCY)
    base = F.lit(base_currency)
    n_amount, n_currency = F.size(amounts), F.size(currencies)
    the_currency = _first(currencies)["col_id"]

    def valid(code: Column) -> Column:
        return symbol_to_iso(F.upper(code))

    def single(c: Column) -> Column:
        """Result struct for one amount column."""
        mode, code = c["currency_mode"], c["currency_code"]
        iso = valid(code)
        return (
            F.when(c["amount_type"] == "income", _choice(c, error="income-only-column"))
            .when(mode.isNull() | (mode == "use_base"), _choice(c, fixed=base))
            .when(
                mode == "auto",
                F.when(n_currency == 0, _choice(c, fixed=base))
                .when(n_currency == 1, _choice(c, column=the_currency))
                .otherwise(_choice(c, error="multiple-currency-columns")),
            )
            .when(iso.isNotNull(), _choice(c, fixed=iso))
            .otherwise(_choice(c, error="invalid-currency-code"))
        )

    def where(test) -> Column:
        return _first(F.filter(amounts, test))

    income = where(lambda c: c["amount_type"] == "income")
    outcome = where(lambda c: c["amount_type"] == "outcome")
    auto = where(lambda c: c["currency_mode"] == "auto")
    use_base = where(lambda c: c["currency_mode"] == "use_base")
    in_base = where(lambda c: (c["currency_mode"] == "code") & (c["currency_code"] == base_currency))
    in_usd = where(lambda c: (c["currency_mode"] == "code") & (c["currency_code"] == "USD"))
    coded = where(lambda c: (c["currency_mode"] == "code") & valid(c["currency_code"]).isNotNull())
    several = (
        F.when(income.isNotNull() & outcome.isNotNull(), single(outcome))
        .when((n_currency == 1) & auto.isNotNull(), _choice(auto, column=the_currency))
        .when(use_base.isNotNull(), _choice(use_base, fixed=base))
        .when(in_base.isNotNull(), _choice(in_base, fixed=base))
        .when(in_usd.isNotNull(), _choice(in_usd, fixed=F.lit("USD")))
        .when(coded.isNotNull(), _choice(coded, fixed=valid(coded["currency_code"])))
        .otherwise(_choice(_first(amounts), error="undetermined-amount"))
    )
    chosen = (
        F.when(n_amount == 1, single(_first(amounts)))
        .when(n_amount > 1, several)
        .otherwise(_choice(_first(amounts), error="no-amount-column"))
    )
    return columns.withColumn("_choice", chosen).select("*", "_choice.*").drop("_choice")


def _choice(c: Column, column=None, fixed=None, error=None) -> Column:
    none = F.lit(None)
    return F.struct(
        c["col_id"].alias("amount_col"),
        (none if column is None else column).cast("int").alias("currency_col"),
        (none if fixed is None else fixed).cast("string").alias("currency_fixed"),
        F.lit(error).cast("string").alias("choice_error"),
    )


def structural_errors(columns: DataFrame) -> DataFrame:
    """Files that cannot yield rows: no date column, or more than one."""
    n = F.size(_of(m.DATE))
    reason = F.when(n == 0, "structural-no-date-column").when(n > 1, "structural-multiple-date-columns")
    return columns.select("file_id", reason.alias("reason")).where("reason is not null")


# --------------------------------------------------------------- row projections


def _typed(definition: str) -> Column:
    return _of(definition, "typed")


# A filter over the cells is a lambda, which Spark interprets for each row. The first cell
# of a definition is found by its place instead, and only several cells meet a lambda.


def first_cell(definition: str) -> Column:
    return F.get("typed", F.array_position("typed.definition", definition).cast("int") - 1)


def _cells(definition: str) -> Column:
    """How many cells of a row have the definition."""
    return F.size("typed.definition") - F.size(F.array_remove("typed.definition", definition))


def _one_or_many(definition: str, one: Column, many: Column) -> Column:
    return F.when(_cells(definition) == 1, one).when(_cells(definition) > 1, many)


def joined_text(definition: str) -> Column:
    """One column: its value. Several: the non-empty ones joined by a blank."""
    values = F.transform(_typed(definition), lambda c: c["v"]["text"])
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return _one_or_many(definition, first_text(definition), F.array_join(filled, " "))


def first_text(definition: str) -> Column:
    return first_cell(definition)["v"]["text"]


def _first_ignore(definition: str) -> Column:
    several = _first(F.filter("typed", lambda c: (c["definition"] == definition) & c["v"]["ignore"].isNotNull()))
    return _one_or_many(definition, first_cell(definition)["v"]["ignore"], several["v"]["ignore"])


def ignore_reason() -> Column:
    """Label of the first AMOUNT column that says the row is no expense."""
    return _first_ignore(m.AMOUNT)


def status_reason() -> Column:
    return _first_ignore(m.STATUS)


def _identity_texts() -> dict[str, Column]:
    def told(definition: str, text) -> Column:
        one = F.coalesce(text(first_cell(definition)["v"]), F.lit(NULL_MARK))
        return _one_or_many(definition, one, many_text(F.transform(_typed(definition), lambda c: text(c["v"]))))

    text = lambda d: told(d, lambda v: v["text"])
    number = lambda d: told(d, lambda v: number_text(v["number"]))
    return {
        "date": told(m.DATE, lambda v: v["date"].cast("string")),
        "amount": number(m.AMOUNT),
        "description": text(m.DESCRIPTION),
        "counterparty": text(m.COUNTERPARTY),
        "currency": text(m.CURRENCY),
        "balance": number(m.BALANCE),
        "account": text(m.BANK_ACCOUNT),
        "mcc": text(m.MERCHANT_CATEGORY),
        "exchange_rate": number(m.EXCHANGE_RATE),
    }


def _side_operation(kind: str, label: str, base_currency: str, spawn: Column, date: Column) -> Column:
    """Commission or cashback of a row as its own operation, or null.

    Without an amount there is none; an unreadable cell or a missing date
    becomes an error, so that no money is lost silently.
    """
    cell, col = F.col(f"_{kind}"), F.col(f"_{kind}_column")
    iso = symbol_to_iso(F.upper(col["currency_code"]))
    currency = F.when(col["currency_mode"] == "code", iso).otherwise(F.lit(base_currency))
    error = F.coalesce(
        cell["error"], F.when(currency.isNull(), "unknown-currency-code"), F.when(date.isNull(), "no-date")
    )
    present = spawn & (cell["number"].isNotNull() | cell["error"].isNotNull())
    state = F.when(error.isNull(), "ok").otherwise("error")
    return F.when(present, _operation(kind, state, error, F.abs(cell["number"]), currency, F.lit(label)))


def _operation(kind: str, state: Column, reason: Column, amount: Column, currency: Column, description: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(KINDS.index(kind)).alias("kind_order"),
        state.alias("state"),
        reason.cast("string").alias("reason"),
        amount.cast("double").alias("amount"),
        currency.cast("string").alias("currency"),
        description.cast("string").alias("description"),
    )


def operations(typed: DataFrame, base_currency: str, honor_status: bool = False) -> DataFrame:
    """One tagged row per operation: ``state`` is ok, error or skipped.

    ``typed`` carries the per-file choice columns. A kept or skipped row also
    yields its commission and cashback; an unreadable row yields nothing else.
    Files with structural errors must be removed before.

    What several results need is looked up once, in a projection of its own that
    carries no lists of cells on.
    """
    at = lambda i: F.get("typed", F.array_position("typed.col_id", F.col(i)).cast("int") - 1)["v"]
    skip = F.coalesce(ignore_reason(), status_reason()) if honor_status else ignore_reason()
    sides = (("commission", m.BANK_COMMISSION), ("cashback", m.CASHBACK))
    facts = typed.select(
        "file_id",
        F.col("row_index").alias("source_row"),
        "row_block",
        "currency_fixed",
        "choice_error",
        first_cell(m.DATE)["v"].alias("_day"),
        at("amount_col").alias("_amount"),
        at("currency_col").alias("_currency"),
        skip.alias("_skip"),
        joined_text(m.DESCRIPTION).alias("_description"),
        joined_text(m.BANK_ACCOUNT).alias("account"),
        joined_text(m.COUNTERPARTY).alias("_counterparty"),
        first_text(m.CATEGORY).alias("_bank_category"),
        first_text(m.MERCHANT_CATEGORY).alias("_mcc"),
        base_hash(_identity_texts(), F.lit("")).alias("_row_text"),
        *[first_cell(d)["v"].alias(f"_{kind}") for kind, d in sides],
        *[F.get("cols", F.array_position("cols.definition", d).cast("int") - 1).alias(f"_{kind}_column") for kind, d in sides],
    )
    date, skip = F.col("_day.date"), F.col("_skip")
    currency = F.coalesce(F.col("currency_fixed"), F.col("_currency.text"))
    error = F.coalesce(
        F.col("choice_error"),
        F.when(date.isNull(), F.coalesce(F.col("_day.error"), F.lit("no-date"))),
        F.when(F.col("_amount.number").isNull(), F.coalesce(F.col("_amount.error"), F.lit("no-amount"))),
        F.when(currency.isNull(), F.coalesce(F.col("_currency.error"), F.lit("no-currency"))),
    )
    skipped = skip.isNotNull()
    state = F.when(skipped, "skipped").when(error.isNotNull(), "error").otherwise("ok")
    reason = F.when(skipped, skip).otherwise(error)
    spawn = skipped | error.isNull()
    row = _operation("main", state, reason, F.col("_amount.number"), currency, F.col("_description"))
    labelled = (("commission", COMMISSION_LABEL), ("cashback", CASHBACK_LABEL))
    beside = [_side_operation(kind, label, base_currency, spawn, date) for kind, label in labelled]
    present = lambda op: F.slice(F.array(op), F.lit(1), F.when(op.isNull(), 0).otherwise(1))
    main = F.col("op.kind") == "main"
    kept = ("account", "_counterparty", "_bank_category", "_mcc", "_row_text")
    found = F.concat(F.array(row), *[present(op) for op in beside]).alias("_ops")
    listed = facts.select("file_id", "source_row", "row_block", date.alias("date"), *kept, found)
    return listed.select("file_id", "source_row", "row_block", "date", *kept, F.explode("_ops").alias("op")).select(
        "file_id",
        "source_row",
        "row_block",
        "op.kind",
        "op.kind_order",
        "op.state",
        "op.reason",
        "date",
        "op.amount",
        "op.currency",
        "op.description",
        F.when(main, F.col("_counterparty")).alias("counterparty"),
        "account",
        F.when(main, F.col("_bank_category")).alias("bank_category"),
        F.when(main, F.col("_mcc")).alias("mcc"),
        (F.col("op.kind") == "commission").alias("is_bank_commission"),
        (F.col("op.kind") == "cashback").alias("is_cashback"),
        F.sha2(F.concat_ws("|", "_row_text", "op.kind"), 256).alias("base_hash"),
    )


def transactions(ops: DataFrame) -> DataFrame:
    """Kept operations with dense row index and final hash.

    Copies are numbered in the order of the index, but before it, so that the
    operations are moved once, by the index itself.
    """
    kept = ops.where("state = 'ok'").drop("state", "reason")
    order = ["source_row", "kind_order"]
    indexed = dense_index(with_final_hash(kept, "file_id", order, "row_block"), ["file_id"], "row_block", order)
    return indexed.select(*kept.columns, "row_index", "dup", "hash")


def row_errors(ops: DataFrame) -> DataFrame:
    return ops.where("state = 'error'").select("file_id", "source_row", "kind", "reason")


def skipped_rows(ops: DataFrame) -> DataFrame:
    return ops.where("state = 'skipped'").select("file_id", "source_row", "reason")


def kind_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))
