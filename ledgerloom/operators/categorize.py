"""Category resolution: pick, stored override, rule, remainder category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.identity import KEY_BITS, with_key_bits
from ledgerloom.model import FOOTPRINT_KEY
from ledgerloom.operators.conditions import FIELD_OPERATORS, VALUE_KINDS, Condition, Rule, compile_conditions
from ledgerloom.operators.rules import with_rule, with_rule_by_set


def with_period(txns: DataFrame) -> DataFrame:
    return txns.withColumn("year", F.year("date")).withColumn("month", F.month("date"))


def periods(txns: DataFrame) -> DataFrame:
    """Distinct calendar months of a batch."""
    return txns.select(F.year("date").alias("year"), F.month("date").alias("month")).distinct()


def manual_overrides(footprints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored manual decisions of the wanted months that name a category."""
    return (
        footprints.where("is_manual = 1 and category_id is not null")
        .join(wanted, ["year", "month"], "left_semi")
        .select("hash", "year", "month", F.col("category_id").alias("override_category"))
    )


def with_override(txns: DataFrame, overrides: DataFrame, categories: DataFrame) -> DataFrame:
    """Attach the stored decision and whether its category still exists."""
    known = categories.select(F.col("id").alias("override_category"), F.lit(True).alias("_known"))
    valid = overrides.join(known, "override_category", "left")
    valid = with_key_bits(valid.dropna(subset=list(FOOTPRINT_KEY)), FOOTPRINT_KEY).drop(*FOOTPRINT_KEY)
    met = with_key_bits(with_period(txns), FOOTPRINT_KEY).join(valid, list(KEY_BITS), "left").drop(*KEY_BITS)
    named = met.withColumn("valid_override", F.when(F.col("_known"), F.col("override_category"))).drop("_known")
    return named.select(*FOOTPRINT_KEY, *[c for c in named.columns if c not in FOOTPRINT_KEY])


def effective_category(dump: Column | None = None) -> Column:
    levels = [
        F.when(F.col("is_manually_set"), F.col("picked_category")),
        F.col("valid_override"),
        F.col("rule_category"),
    ]
    return F.coalesce(*levels, dump) if dump is not None else F.coalesce(*levels)


def categorize(
    txns: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    overrides: DataFrame,
    categories: DataFrame,
    dump_category: str | None = None,
) -> DataFrame:
    """Resolve every row; ``is_manual`` marks picks and stored overrides.

    A stored override counts as manual even when its category is gone; the
    category then comes from the rules. ``dump_category`` sweeps what is left
    (a name that is no category sweeps nothing). ``rules`` is a literal list, or
    a table of rule sets for rows with a ``ruleset_id``.
    """
    base = txns
    for name, default in (("picked_category", F.lit(None).cast("string")), ("is_manually_set", F.lit(False))):
        if name not in base.columns:
            base = base.withColumn(name, default)
    ruled = with_rule_by_set(base, rules) if isinstance(rules, DataFrame) else with_rule(base, rules)
    resolved = with_override(ruled, overrides, categories)
    dump = None
    if dump_category is not None and not categories.where(F.col("id") == dump_category).isEmpty():
        dump = F.lit(dump_category)
    manual = F.col("is_manually_set") | F.col("override_category").isNotNull()
    return resolved.withColumn("category_id", effective_category(dump)).withColumn("is_manual", manual.cast("int"))


def active_categories(categories: DataFrame, include_archived: bool = False) -> DataFrame:
    return categories if include_archived else categories.where(~F.col("is_archived"))


def resolve_base_alias(categories: DataFrame, base_currency: str) -> DataFrame:
    alias = F.when(F.col("currency") == "base", F.lit(base_currency)).otherwise(F.col("currency"))
    return categories.withColumn("currency", alias)


def uncategorized(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("category_id").isNull())


def draft_matches(txns: DataFrame, draft: Sequence[Condition]) -> DataFrame:
    return txns.where(compile_conditions(draft))


def window_counts(rows: DataFrame, draft: Sequence[Condition], group: str = "file_id") -> DataFrame:
    """Totals of the category window in one aggregation."""
    hit = compile_conditions(draft)
    return rows.groupBy(group).agg(
        F.count_if(hit).alias("match_count"),
        F.count_if(hit & F.col("category_id").isNull()).alias("uncat_total"),
        F.count_if(F.col("category_id").isNull()).alias("remainder_count"),
    )


def completeness(rows: DataFrame, group: str = "file_id") -> DataFrame:
    left = F.count_if(F.col("category_id").isNull())
    return rows.groupBy(group).agg((left == 0).alias("complete"), left.alias("remaining"))


def changed_rows(rows: DataFrame, current: Column, proposed: Column) -> DataFrame:
    """Rows whose category differs between two rule sets, both evaluated in
    one pass over the rows."""
    both = rows.withColumn("old_category", current).withColumn("new_category", proposed)
    return both.where(~F.col("old_category").eqNullSafe(F.col("new_category")))


def changed_rows_by_set(rows: DataFrame, current: DataFrame, proposed: DataFrame) -> DataFrame:
    """``changed_rows`` for rows that belong to one of many rule sets, stored and proposed."""
    for name, table in (("old_category", current), ("new_category", proposed)):
        rows = with_rule_by_set(rows, table).withColumnRenamed("rule_category", name).drop("rule_id")
    return rows.where(~F.col("old_category").eqNullSafe(F.col("new_category")))


OPTIONAL_FIELDS = ("description", "counterparty", "account", "bank_category", "mcc")


def condition_fields(txns: DataFrame, group: str = "file_id") -> DataFrame:
    """Fields a rule can use per file: ``(file_id, field, value_kind, operators)``.

    Date and amount always; currency when a file has more than one; the
    optional ones when any row carries them. Minimum and maximum decide "more
    than one" without a distinct count.
    """
    flags = [
        F.lit(True).alias("date"),
        F.lit(True).alias("amount"),
        (F.min("currency") < F.max("currency")).alias("currency"),
        *[(F.count(f) > 0).alias(f) for f in OPTIONAL_FIELDS],
    ]
    wide = txns.groupBy(group).agg(*flags)
    names = ["date", "amount", "currency", *OPTIONAL_FIELDS]
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                F.lit(VALUE_KINDS[n]).alias("value_kind"),
                F.lit(",".join(FIELD_OPERATORS[n])).alias("operators"),
                F.coalesce(F.col(n), F.lit(False)).alias("on"),
            )
            for n in names
        ]
    )
    return wide.select(group, F.explode(F.filter(entries, lambda e: e["on"])).alias("e")).select(
        group, "e.field", "e.value_kind", "e.operators"
    )


def options(txns: DataFrame, field: str, group: str = "file_id") -> DataFrame:
    """Distinct values of a field with the row that shows each first."""
    return (
        txns.where(F.col(field).isNotNull())
        .groupBy(group, F.col(field).alias("value"))
        .agg(F.min("row_index").alias("first_row"))
    )
