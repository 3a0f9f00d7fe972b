"""What a column holds: date format, amount sign, dominant status value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom.functions.dates import DATE_FORMATS, has_date_shape, parse_date
from ledgerloom.functions.indexing import in_even_sample, sample_size
from ledgerloom.functions.numbers import parse_number
from ledgerloom.session import materialize


def with_file_size(rows: DataFrame) -> DataFrame:
    """Attach the row count of the file (joined from an aggregate, so a large
    file is never sorted into one task)."""
    sizes = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("file_rows"))
    return rows.join(sizes, "file_id")


def even_sample(rows: DataFrame, percent: float = 10.0, at_least: int = 100, at_most: int = 1000) -> DataFrame:
    """Deterministic evenly spaced rows of each file."""
    sized = with_file_size(rows)
    size = sample_size(F.col("file_rows"), percent, at_least, at_most)
    return sized.where(in_even_sample(F.col("row_index"), F.col("file_rows"), size)).drop("file_rows")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "row_index", F.posexplode("cells").alias("col_id", "raw"))


def date_formats(cells: DataFrame, accept: float = m.MIN_DATE_PARSE_PERCENT) -> DataFrame:
    """Best format per column when it fits at least ``accept`` percent.

    Equal cells are counted first, so every different one is parsed once. All
    formats are counted in one aggregation; ties go to list order.
    """
    values = cells.groupBy("file_id", "col_id", "raw").agg(F.count(F.lit(1)).alias("_k"))
    hit = lambda f: F.when(parse_date(F.col("raw"), f).isNotNull(), F.col("_k")).otherwise(0)
    hits = [F.sum(hit(f)).alias(f"_f{i}") for i, f in enumerate(DATE_FORMATS)]
    counted = values.groupBy("file_id", "col_id").agg(F.sum("_k").alias("_n"), *hits)
    ranked = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"_f{i}").alias("hits"), F.lit(-i).alias("rank"), F.lit(f).alias("format"))
                for i, f in enumerate(DATE_FORMATS)
            ]
        )
    )
    best = counted.select("file_id", "col_id", ranked.alias("b"), "_n")
    percent = F.col("b.hits") * 100.0 / F.col("_n")
    return best.select("file_id", "col_id", F.col("b.format").alias("date_format"), percent.alias("percent")).where(
        F.col("percent") >= accept
    )


def sign_census(cells: DataFrame) -> DataFrame:
    """Both signs: mixed; one sign: outcome; no number: income."""
    x = parse_number(F.col("raw"))
    up, down = F.count_if(F.col("_x") > 0), F.count_if(F.col("_x") < 0)
    kind = (
        F.when((F.col("positive") > 0) & (F.col("negative") > 0), "mixed")
        .when((F.col("positive") > 0) | (F.col("negative") > 0), "outcome")
        .otherwise("income")
    )
    return (
        cells.withColumn("_x", x)
        .groupBy("file_id", "col_id")
        .agg(up.alias("positive"), down.alias("negative"))
        .withColumn("amount_type", kind)
    )


def value_shares(cells: DataFrame) -> DataFrame:
    """Most frequent value per column with its share; ties: seen first."""
    counts = (
        cells.where("raw is not null")
        .groupBy("file_id", "col_id", "raw")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"))
    )
    best = F.struct(F.col("n"), -F.col("first_row"))
    return counts.groupBy("file_id", "col_id").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.max_by("raw", best).alias("value"),
        (F.max("n") / F.sum("n")).alias("share"),
    )


def dominant_status(cells: DataFrame, threshold: float = m.STATUS_DOMINANCE) -> DataFrame:
    return value_shares(cells).where(F.col("share") >= threshold).select("file_id", "col_id", "value", "share")


STATUS_VALUES = 10
SKETCH_BITS = 64


def column_sketches(cells: DataFrame) -> DataFrame:
    """What one aggregation tells of every column without moving its cells.

    ``dates``: cells in the shape of a date; ``different``: a number of different
    values that is never too high, from a bitmap of their hashes (two values may
    share a bit). So a column is only ruled out where its exact counts would
    rule it out as well.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("raw"), F.lit(SKETCH_BITS)).cast("int"))
    return cells.groupBy("file_id", "col_id").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("raw").alias("total"),
        F.count_if(has_date_shape(F.col("raw"))).alias("dates"),
        F.bit_count(F.bit_or(F.when(F.col("raw").isNotNull(), bit))).alias("different"),
    )


def date_candidates(cells: DataFrame, sketches: DataFrame, accept: float = m.MIN_DATE_PARSE_PERCENT) -> DataFrame:
    """The cells of the columns that can be dates: enough of them have the shape of one."""
    able = sketches.where(F.col("dates") * 100.0 >= accept * F.col("cells"))
    return cells.join(able.select("file_id", "col_id"), ["file_id", "col_id"], "left_semi")


def auto_detect(cells: DataFrame) -> DataFrame:
    """Definition by content, judged on all cells: a date column, else a status column.

    Status needs ten values, at most ten distinct ones and one dominant. Only
    the cells of columns that the sketches leave open are counted by value, so
    free text is never shuffled.
    """
    sketches = materialize(column_sketches(cells), "sketches")
    dates = date_formats(date_candidates(cells, sketches)).select("file_id", "col_id", F.lit(m.DATE).alias("definition"))
    few = sketches.where((F.col("total") >= 10) & (F.col("different") <= STATUS_VALUES)).select("file_id", "col_id")
    status = value_shares(cells.join(few, ["file_id", "col_id"], "left_semi")).where(
        (F.col("total") >= 10) & (F.col("distinct_values") <= STATUS_VALUES) & (F.col("share") >= m.STATUS_DOMINANCE)
    )
    status = status.select("file_id", "col_id", F.lit(m.STATUS).alias("definition"))
    return dates.unionByName(status.join(dates, ["file_id", "col_id"], "left_anti"))


def resolve_auto(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fill the automatic parameters of a mapping from the data.

    Only the columns that ask for it are looked at, on all rows.
    """
    ask = F.when(
        ((F.col("definition") == m.DATE) & F.col("date_format").eqNullSafe("auto"))
        | ((F.col("definition") == m.AMOUNT) & F.coalesce("amount_type", F.lit("auto")).eqNullSafe("auto"))
        | ((F.col("definition") == m.STATUS) & F.col("success_value").eqNullSafe("auto")),
        F.col("definition"),
    )
    wanted = mapping.select("file_id", "col_id", ask.alias("_ask")).where("_ask is not null")
    # stored, so that Spark knows how small it is and need not move the rows to meet it
    asked = wanted.groupBy("file_id", "_ask").agg(F.collect_list("col_id").alias("_ids"))
    asked = materialize(asked, "asked")

    def cells(of: DataFrame, definition: str) -> DataFrame:
        ids = asked.where(F.col("_ask") == definition).select("file_id", "_ids")
        picked = F.transform("_ids", lambda i: F.struct(i.alias("col_id"), F.get("cells", i).alias("raw")))
        return (
            of.join(ids, "file_id")
            .select("file_id", "row_index", F.explode(picked).alias("c"))
            .select("file_id", "row_index", "c.col_id", "c.raw")
        )

    formats = date_formats(cells(rows, m.DATE)).select("file_id", "col_id", F.col("date_format").alias("_fmt"))
    signs = sign_census(cells(rows, m.AMOUNT)).select("file_id", "col_id", F.col("amount_type").alias("_sign"))
    status = dominant_status(cells(rows, m.STATUS)).select("file_id", "col_id", F.col("value").alias("_value"))
    key = ["file_id", "col_id"]
    joined = mapping.join(formats, key, "left").join(signs, key, "left").join(status, key, "left")
    auto = lambda c, found: F.when(F.col(c).eqNullSafe("auto"), F.col(found)).otherwise(F.col(c))
    kind = F.when(
        (F.col("definition") == m.AMOUNT) & F.coalesce("amount_type", F.lit("auto")).eqNullSafe("auto"),
        F.coalesce("_sign", F.lit("income")),
    ).otherwise(F.col("amount_type"))
    return (
        joined.withColumn("date_format", auto("date_format", "_fmt"))
        .withColumn("amount_type", kind)
        .withColumn("success_value", auto("success_value", "_value"))
        .drop("_fmt", "_sign", "_value")
    )


def undetected(mapping: DataFrame) -> DataFrame:
    """Columns whose automatic parameter could not be found; their transform
    is refused as a whole."""
    reason = F.when((F.col("definition") == m.DATE) & F.col("date_format").isNull(), "date-format-not-detected").when(
        (F.col("definition") == m.STATUS) & F.col("success_value").isNull(), "no-dominant-status-value"
    )
    return mapping.select("file_id", "col_id", reason.alias("reason")).where("reason is not null")
