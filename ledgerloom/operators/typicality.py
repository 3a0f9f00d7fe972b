"""Outliers inside a rule's rows: robust profiles and a noisy-OR score."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.stats import weighted_median
from ledgerloom.functions.text import tokens
from ledgerloom.operators.conditions import Condition, Rule, compile_conditions
from ledgerloom.operators.rules import first_match, with_rule_by_set
from ledgerloom.session import materialize

# Fixed values of the method.
MIN_BUCKET = 8
MIN_AMOUNTS = 5
MIN_LOG_MAD = 0.1
MAD_SIGMA = 1.4826
Z_START = 3.0
Z_FULL = 6.0
FLAG_AT = 0.6
MODE_GATE = 0.5
COVERAGE_GATE = 0.5
CORE_DF = 0.5
REASON_AT = 0.5
TEXT_CAP = 0.5

CATEGORICAL = ("mcc", "counterparty", "currency", "bank_category")
FIELD_RANK = {"mcc": 0, "amount": 1, "description": 2, "counterparty": 3, "currency": 4, "bank_category": 5}


def rule_fields(rules: Sequence[Rule]) -> dict[int, set[str]]:
    """Profiled fields each rule already filters on.

    An amount condition also filters on its currency.
    """
    out: dict[int, set[str]] = {}
    for r in rules:
        used = {c.field for c in r.conditions}
        if "amount" in used:
            used.add("currency")
        out[r.rule_id] = used & set(FIELD_RANK)
    return out


def by_winning_rule(txns: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows with ``bucket`` = winning rule; rows no rule accepts drop out."""
    return txns.withColumn("bucket", first_match(rules).cast("long")).where("bucket is not null")


def _bucket_of_set() -> Column:
    return F.concat_ws("/", F.col("ruleset_id").cast("string"), F.col("rule_id").cast("string"))


def rule_fields_by_set(rules: DataFrame) -> DataFrame:
    """``(bucket, field)``: the profiled fields each rule of many sets already filters on."""
    long = rules.select(_bucket_of_set().alias("bucket"), F.explode("conditions.field").alias("field"))
    also = long.where("field = 'amount'").withColumn("field", F.lit("currency"))
    return long.unionByName(also).where(F.col("field").isin(*FIELD_RANK)).distinct()


def by_winning_rule_by_set(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with ``bucket`` = rule set and winning rule; rows no rule accepts drop out."""
    won = with_rule_by_set(txns, rules).where("rule_id is not null")
    return won.withColumn("bucket", _bucket_of_set()).drop("rule_id", "rule_category")


def by_draft(txns: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    return txns.where(compile_conditions(conditions)).withColumn("bucket", F.lit(0).cast("long"))


# ----------------------------------------------------------------- profiles


def facts(rows: DataFrame, skip: Iterable[str] = (), letters: str = "a-z") -> DataFrame:
    """Everything the profiles need, counted in one aggregation.

    ``(bucket, field, value, number, n, first_row)``: the row itself, the four
    categorical values, the amount per currency, and each distinct word. Every
    fact is counted map-side first, so a bucket with a third of all rows
    reaches the shuffle as its distinct facts only.
    """
    none = F.lit(None)

    def fact(field: str, value: Column, number: Column = none) -> Column:
        return F.struct(
            F.lit(field).alias("field"), value.cast("string").alias("value"), number.cast("double").alias("number")
        )

    words = F.array_distinct(tokens(F.col("description"), letters))
    if skip:
        words = F.array_except(words, F.array(*[F.lit(s) for s in skip]))
    single = [fact("row", none)]
    if "amount" in rows.columns:
        present = [F.when(F.col(f) != "", fact(f, F.col(f))) for f in CATEGORICAL]
        single += [*present, fact("amount", F.col("currency"), F.col("amount"))]
    listed = F.concat(F.array_compact(F.array(*single)), F.transform(words, lambda t: fact("token", t)))
    row = F.col("row_index") if "row_index" in rows.columns else none.cast("long")
    return (
        rows.select("bucket", row.alias("row_index"), F.explode(listed).alias("f"))
        .groupBy("bucket", "f.field", "f.value", "f.number")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"))
    )


def bucket_sizes(found: DataFrame) -> DataFrame:
    return found.where("field = 'row'").select("bucket", F.col("n").alias("bucket_size"))


def categorical_counts(found: DataFrame) -> DataFrame:
    """Occurrences per bucket, field and present value."""
    return found.where(F.col("field").isin(*CATEGORICAL)).select("bucket", "field", "value", "n", "first_row")


def categorical_profile(found: DataFrame) -> DataFrame:
    """Mode, its share and the field's coverage; ties go to the value seen first."""
    best = F.struct(F.col("n"), (-F.col("first_row")).alias("early"))
    return (
        categorical_counts(found)
        .groupBy("bucket", "field")
        .agg(F.sum("n").alias("present"), F.max("n").alias("mode_n"), F.max_by("value", best).alias("mode"))
        .join(bucket_sizes(found), "bucket")
        .select(
            "bucket",
            "field",
            "present",
            "mode",
            (F.col("mode_n") / F.col("present")).alias("p_mode"),
            (F.col("present") / F.col("bucket_size")).alias("coverage"),
        )
    )


def amount_profile(found: DataFrame) -> DataFrame:
    """Raw median, log median and log MAD per bucket and currency.

    Works on distinct amounts with counts. The raw and the log median come from
    one pass; the deviations need the log median and are a second one.
    """
    group = ["bucket", "currency"]
    amounts = found.where("field = 'amount'").select("bucket", F.col("value").alias("currency"), "number", "n")
    log = F.ln(F.abs(F.nullif("number", F.lit(0.0))))
    scales = F.array(
        F.struct(F.lit("raw").alias("scale"), F.col("number").alias("x")),
        F.struct(F.lit("log").alias("scale"), log.alias("x")),
    )
    both = amounts.select(*group, "n", F.explode(scales).alias("s")).select(*group, "n", "s.scale", "s.x")
    medians = weighted_median(both.where("x is not null"), [*group, "scale"], "x", "n", "median")
    center = medians.groupBy(*group).agg(
        F.max(F.when(F.col("scale") == "raw", F.col("median"))).alias("raw_median"),
        F.max(F.when(F.col("scale") == "log", F.col("median"))).alias("log_median"),
    )
    center = materialize(center, "medians")
    deviations = (
        amounts.withColumn("log", log)
        .where("log is not null")
        .join(center, group)
        .select(*group, "n", F.abs(F.col("log") - F.col("log_median")).alias("dev"))
    )
    mad = weighted_median(deviations, group, "dev", "n", "log_mad")
    sizes = amounts.where("number <> 0").groupBy(*group).agg(F.sum("n").alias("amount_n"))
    return center.join(mad, group, "left").join(sizes, group, "left").select(
        *group,
        "raw_median",
        F.coalesce("log_median", F.lit(0.0)).alias("log_median"),
        F.coalesce("log_mad", F.lit(0.0)).alias("log_mad"),
        F.coalesce("amount_n", F.lit(0)).alias("amount_n"),
    )


def token_frequency(found: DataFrame) -> DataFrame:
    """Share of a bucket's rows whose description holds the token."""
    words = found.where("field = 'token'").select("bucket", F.col("value").alias("token"), "n")
    return words.join(bucket_sizes(found), "bucket").select(
        "bucket", "token", (F.col("n") / F.col("bucket_size")).alias("df")
    )


# -------------------------------------------------------------------- gates


def informative_categorical(profile: DataFrame, filtered: dict[int, set[str]] | DataFrame) -> DataFrame:
    """Fields that are mostly filled and mostly one value, and not ``filtered`` by the bucket's rule."""
    if isinstance(filtered, DataFrame):
        open_ = profile.join(filtered, ["bucket", "field"], "left_anti")
        return open_.where((F.col("coverage") >= COVERAGE_GATE) & (F.col("p_mode") >= MODE_GATE))
    used = F.lit(False)
    for bucket, names in filtered.items():
        if names:
            used = used | ((F.col("bucket") == bucket) & F.col("field").isin(*sorted(names)))
    return profile.where((F.col("coverage") >= COVERAGE_GATE) & (F.col("p_mode") >= MODE_GATE) & ~used)


def informative_amounts(profile: DataFrame) -> DataFrame:
    return profile.where((F.col("amount_n") >= MIN_AMOUNTS) & (F.col("log_mad") >= MIN_LOG_MAD))


def core_tokens(frequency: DataFrame) -> DataFrame:
    """Shared words of a bucket, as one map per bucket.

    A bucket has fewer than twice as many core words as its average row has
    words, so the map stays small however large the bucket is.
    """
    return (
        frequency.where(F.col("df") >= CORE_DF)
        .groupBy("bucket")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("core"))
    )


# -------------------------------------------------------------------- scores


def categorical_atypicality(n: Column, present: Column, p_mode: Column) -> Column:
    share = F.coalesce(n, F.lit(0)) / present
    return F.least(F.greatest(1 - share / p_mode, F.lit(0.0)), F.lit(1.0))


def amount_atypicality(amount: Column, log_median: Column, log_mad: Column) -> Column:
    z = F.abs(F.ln(F.abs(F.nullif(amount, F.lit(0.0)))) - log_median) / (F.lit(MAD_SIGMA) * log_mad)
    ramp = F.least(F.greatest((z - Z_START) / F.lit(Z_FULL - Z_START), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(ramp, F.lit(0.0))


def text_atypicality(words: Column, core: Column) -> Column:
    """Rarity of the rarest word, capped.

    A word outside the core map has a rarity above one half, i.e. at the cap,
    so the full token table is not needed to score a row.
    """
    rarity = F.transform(words, lambda t: 1 - F.coalesce(F.try_element_at(core, t), F.lit(0.0)))
    return F.least(F.coalesce(F.array_max(rarity), F.lit(0.0)), F.lit(TEXT_CAP))


def amount_multiple(amount: Column, raw_median: Column) -> Column:
    """How many times the median the amount is, rounded half up."""
    ratio = F.try_divide(F.abs(amount), F.abs(raw_median))
    return F.coalesce(F.floor(ratio + 0.5), F.lit(0)).cast("long")


def noisy_or(scores: Column) -> Column:
    """1 - product of (1 - a); exact also where a score is 1."""
    return 1 - F.aggregate(scores, F.lit(1.0), lambda acc, s: acc * (1 - s["a"]))


@dataclass(frozen=True)
class Profile:
    """Stored profiles of all buckets (see ``fit``)."""

    facts: DataFrame
    values: DataFrame
    amounts: DataFrame
    buckets: DataFrame


def fit(rows: DataFrame, filtered: dict[int, set[str]] | DataFrame, skip: Iterable[str] = ()) -> Profile:
    """Profile the buckets; every intermediate result is stored once.

    One pass over the rows; all further steps read the stored facts.
    """
    found = materialize(facts(rows, skip), "facts")
    informative = informative_categorical(categorical_profile(found), filtered)
    a = categorical_atypicality(F.col("n"), F.col("present"), F.col("p_mode"))
    values = informative.join(categorical_counts(found), ["bucket", "field"]).select(
        "bucket", "field", "value", a.alias("a")
    )
    buckets = bucket_sizes(found).join(core_tokens(token_frequency(found)), "bucket", "left")
    return Profile(
        found,
        materialize(values, "values"),
        materialize(informative_amounts(amount_profile(found)), "amounts"),
        materialize(buckets, "buckets"),
    )


def score(rows: DataFrame, profile: Profile, skip: Iterable[str] = ()) -> DataFrame:
    """Every row of the buckets large enough, with its field scores.

    Adds ``bucket_size``, ``scores`` (array of rank, field, a, value) and
    ``atypicality``. The row keeps its place: all sides hold one row per key.
    """
    out = rows.join(profile.buckets.where(F.col("bucket_size") >= MIN_BUCKET), "bucket")
    parts: list[Column] = []
    for f in CATEGORICAL:
        side = profile.values.where(F.col("field") == f).select(
            "bucket", F.col("value").alias(f), F.col("a").alias(f"_a_{f}")
        )
        out = out.join(side, ["bucket", f], "left")
        parts.append(_score(f, F.col(f"_a_{f}"), F.col(f)))
    out = out.join(profile.amounts, ["bucket", "currency"], "left")
    a = F.when(F.col("log_mad").isNotNull(), amount_atypicality(F.col("amount"), F.col("log_median"), F.col("log_mad")))
    parts.append(_score("amount", a, amount_multiple(F.col("amount"), F.col("raw_median")).cast("string")))
    words = F.array_distinct(tokens(F.col("description")))
    if skip:
        words = F.array_except(words, F.array(*[F.lit(s) for s in skip]))
    text = F.when(F.col("core").isNotNull(), text_atypicality(words, F.col("core")))
    parts.append(_score("description", text, F.lit(None).cast("string")))
    out = out.withColumn("scores", F.filter(F.array(*parts), lambda s: s["a"].isNotNull()))
    out = out.withColumn("atypicality", noisy_or(F.col("scores")))
    extra = [*[f"_a_{f}" for f in CATEGORICAL], "core", "raw_median", "log_median", "log_mad", "amount_n"]
    return out.drop(*extra)


def _score(field: str, a: Column, value: Column) -> Column:
    return F.struct(
        F.lit(FIELD_RANK[field]).alias("rank"), F.lit(field).alias("field"), a.alias("a"), value.alias("value")
    )


def flagged(scored: DataFrame) -> DataFrame:
    """Rows over the absolute limit with their reasons, strongest field first."""
    reasons = F.array_sort(F.filter("scores", lambda s: s["a"] >= REASON_AT))
    return scored.where(F.col("atypicality") >= FLAG_AT).withColumn("reasons", reasons)


def rare_tokens(flagged_rows: DataFrame, frequency: DataFrame, key: Sequence[str] = ("bucket", "row_index")) -> DataFrame:
    """The words that drive a flagged row: all at its highest rarity.

    Runs on flagged rows only; the token table is joined, not collected.
    """
    words = F.array_distinct(tokens(F.col("description")))
    long = flagged_rows.select(*key, F.explode(words).alias("token"))
    with_df = long.join(frequency, ["bucket", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0.0)))
    lowest = with_df.groupBy(*key).agg(F.min("df").alias("_low"))
    return (
        with_df.join(lowest, list(key))
        .where(F.col("df") == F.col("_low"))
        .groupBy(*key)
        .agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("rare_tokens"))
    )


def flag_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("bucket_size"),
        F.count_if(F.col("atypicality") >= FLAG_AT).alias("flagged"),
        F.avg((F.col("atypicality") >= FLAG_AT).cast("double")).alias("flag_rate"),
    )


def flag_rate_summary(scored: DataFrame) -> DataFrame:
    """Overall share of flagged rows and the worst bucket's share."""
    per = flag_rates(scored)
    return per.agg(
        (F.sum("flagged") / F.sum("bucket_size")).alias("overall_rate"), F.max("flag_rate").alias("worst_rate")
    )
