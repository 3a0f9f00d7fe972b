"""Header detection, column keys and row keying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.indexing import dense_index, in_even_sample
from ledgerloom.functions.text import PLACEHOLDER_CELLS, trimmed

# Fixed values of the scoring.
LOOK_AHEAD = 3
SCORE_FLOOR = 0.30
EMPTY_DISCOUNT = 0.05
TEXT_BONUS = 1.5
DATA_PENALTY = 0.15
DATA_FLOOR = 0.10
WIDTH_BONUS = 0.001
SUMMARY_MAX_FILL = 0.40
SUMMARY_WORDS = ("Разом", "Всього", "Total", "Итого")

# What a number, a date and an amount look like in a cell.
_NUMBER = (
    r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?Infinity|0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+)$"
)
_DATE = r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
_AMOUNT = r"^[-+]?\d[\d\s.,]*"


def _likeness(cells: Column) -> Column:
    """What a row's own cells say: distinct texts, mostly text, dates and amounts, width."""
    width = F.size(cells)
    filled = F.filter(F.transform(cells, trimmed), lambda t: t != "")
    texts = F.filter(filled, lambda t: ~F.regexp_replace(t, "^([^,]*),", "$1.").rlike(_NUMBER))
    data_like = F.size(F.filter(texts, lambda t: t.rlike(_DATE) | t.rlike(_AMOUNT)))
    raw = F.coalesce(F.try_divide(F.size(F.array_distinct(texts)), F.size(filled)), F.lit(0.0))
    return F.struct(
        (raw * (1 - F.lit(EMPTY_DISCOUNT) * (width - F.size(filled)) / width)).alias("soft"),
        F.when(raw >= 0.5, TEXT_BONUS).otherwise(1.0).alias("bonus"),
        F.greatest(F.lit(DATA_FLOOR), 1 - F.lit(DATA_PENALTY) * data_like).alias("penalty"),
    )


def steadiness(width: Column, next_widths: Column) -> Column:
    """The share of the following rows that are at least as wide."""
    wide = F.size(F.filter(next_widths, lambda w: w >= width))
    return F.coalesce(F.try_divide(wide, F.size(next_widths)), F.lit(1.0))


def leading_rows(rows: DataFrame, scan_rows: int) -> DataFrame:
    """The first rows of each file, plus the ones looked ahead to.

    The filter on the plain number lets every task keep only its first rows of
    a file.
    """
    order = W.partitionBy("file_id").orderBy("src_row")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= scan_rows + LOOK_AHEAD)
    return first.withColumn("_at", F.col("_n") - 1).drop("_n")


def with_next_widths(rows: DataFrame) -> DataFrame:
    """Add ``_widths``, the widths of the next rows of the file.

    ``rows`` has ``file_id, src_row, row_block, width``. Widths are looked up
    inside bounded blocks; what a block needs from behind its end comes from
    the first rows of the blocks that follow, one row per block.
    """
    inside = W.partitionBy("file_id", "row_block").orderBy("src_row")
    heads = (
        rows.withColumn("_n", F.row_number().over(inside))
        .where(F.col("_n") <= LOOK_AHEAD)
        .groupBy("file_id", "row_block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "width"))), lambda x: x["width"]).alias("_head"))
    )
    behind = W.partitionBy("file_id").orderBy("row_block").rowsBetween(1, LOOK_AHEAD)
    ends = heads.select("file_id", "row_block", F.flatten(F.collect_list("_head").over(behind)).alias("_behind"))
    own = F.array_compact(F.array(*[F.lead("width", i).over(inside) for i in range(1, LOOK_AHEAD + 1)]))
    met = rows.withColumn("_own", own).join(ends, ["file_id", "row_block"])
    return met.withColumn("_widths", F.slice(F.concat("_own", "_behind"), 1, LOOK_AHEAD)).drop("_own", "_behind")


def scored_rows(rows: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """``(file_id, src_row, score)``: the header likeness of every row.

    Distinct texts over filled cells, mildly discounted for empty cells; times
    the share of following rows at least as wide; times a bonus for mostly
    text; times a penalty for dates and amounts; plus a little for width. All
    rows are scored, or only the first ``scan_rows`` of each file. The cells
    themselves are not shuffled.
    """
    if scan_rows is not None:
        rows = leading_rows(rows, scan_rows)
    kept = ["_at"] if scan_rows is not None else []
    own = rows.select("file_id", "src_row", "row_block", *kept, F.size("cells").alias("width"), _likeness(F.col("cells")).alias("_like"))
    scored = with_next_widths(own)
    if scan_rows is not None:
        scored = scored.where(F.col("_at") < scan_rows)
    score = (
        F.col("_like.soft") * steadiness(F.col("width"), F.col("_widths")) * F.col("_like.bonus") * F.col("_like.penalty")
        + F.col("width") * F.lit(WIDTH_BONUS)
    )
    return scored.select("file_id", "src_row", score.alias("score"))


def detect_headers(rows: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """``(file_id, header_row, score, header_cells)``; the best row, the first
    among equals. Row -1 and no cells when nothing reaches the floor."""
    best = (
        scored_rows(rows, scan_rows)
        .groupBy("file_id")
        .agg(F.max(F.struct(F.col("score"), (-F.col("src_row")).alias("back"))).alias("b"))
        .select("file_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("_row"))
    )
    cells = rows.select("file_id", F.col("src_row").alias("_row"), F.col("cells").alias("_cells"))
    ok = F.col("score") >= SCORE_FLOOR
    return cells.join(best, ["file_id", "_row"]).select(
        "file_id",
        F.when(ok, F.col("_row")).otherwise(F.lit(-1)).cast("long").alias("header_row"),
        "score",
        F.when(ok, F.col("_cells")).alias("header_cells"),
    )


def unique_keys(headers: DataFrame, cells: str = "header_cells") -> DataFrame:
    """``(file_id, keys)``: blanks become ``col_N``, repeats get ``_2``, ``_3``.

    Works on header rows only; occurrences are numbered by a window over the
    exploded cells, so very wide headers stay cheap.
    """
    long = headers.select("file_id", F.posexplode(cells).alias("_i", "_c"))
    blank = F.concat(F.lit("col_"), (F.col("_i") + 1).cast("string"))
    based = long.withColumn("_base", F.when(trimmed(F.col("_c")) == "", blank).otherwise(F.col("_c")))
    nth = F.row_number().over(W.partitionBy("file_id", "_base").orderBy("_i"))
    key = F.when(F.col("_nth") > 1, F.concat_ws("_", "_base", F.col("_nth").cast("string"))).otherwise(F.col("_base"))
    listed = F.array_sort(F.collect_list(F.struct("_i", key.alias("key"))))
    return (
        based.withColumn("_nth", nth)
        .groupBy("file_id")
        .agg(F.transform(listed, lambda k: k["key"]).alias("keys"))
    )


def positional_keys(n: Column) -> Column:
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("col_"), i.cast("string")))).otherwise(
        F.array().cast("array<string>")
    )


def with_keys(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys per file; files without a header get positions up to their widest
    row."""
    widest = rows.groupBy("file_id").agg(F.max(F.size("cells")).alias("_widest"))
    named = unique_keys(headers).withColumnRenamed("keys", "_named")
    return (
        headers.join(widest, "file_id")
        .join(named, "file_id", "left")
        .withColumn("keys", F.coalesce("_named", positional_keys(F.col("_widest"))))
        .drop("_widest", "_named")
    )


def header_issues(headers: DataFrame) -> DataFrame:
    """Missing header, empty header cells, renamed duplicates."""
    cells = F.col("header_cells")
    missing = F.when(F.col("header_row") < 0, F.array(_issue(F.lit(-1), "no-header", None, "no-data")))

    def renamed(c: Column, i: Column) -> Column:
        blank = trimmed(c) == ""
        base = F.when(blank, F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(c)
        dup = F.get("keys", i) != base
        col = i.cast("int")
        found = F.array(
            F.when(blank, _issue(F.col("header_row"), "empty-header-cell", c, "renamed-column", col)),
            F.when(dup, _issue(F.col("header_row"), "duplicate-column", base, "renamed-column", col)),
        )
        return F.array_compact(found)

    listed = F.coalesce(missing, F.flatten(F.transform(cells, renamed)))
    return headers.select("file_id", F.explode(listed).alias("i")).select("file_id", "i.*")


def _issue(row: Column, what: str, raw: Column | None, action: str, column: Column | None = None) -> Column:
    return F.struct(
        row.cast("long").alias("row"),
        (F.lit(None) if column is None else column).cast("int").alias("column"),
        F.lit(what).alias("what"),
        (F.lit(None) if raw is None else raw).cast("string").alias("raw"),
        F.lit(action).alias("action"),
    )


# -------------------------------------------------------------------- keying


def is_placeholder(cells: Column) -> Column:
    return F.forall(cells, lambda c: trimmed(c).isin(*PLACEHOLDER_CELLS))


def is_summary(cells: Column) -> Column:
    """A total line: keyword first, and the rest mostly empty."""
    keyword = trimmed(F.get(cells, F.lit(0))).rlike("(?iu)^(?:" + "|".join(SUMMARY_WORDS) + ")")
    rest = F.filter(F.slice(cells, F.lit(2), F.size(cells)), lambda c: trimmed(c) != "")
    return keyword & (F.size(rest) / F.size(cells) <= SUMMARY_MAX_FILL)


def classify_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Label every row: preamble, header, placeholder, summary or data; data
    rows also get ``ragged`` (short, long or null)."""
    joined = rows.join(headers.select("file_id", "header_row", "keys"), "file_id")
    at, head, cells = F.col("src_row"), F.col("header_row"), F.col("cells")
    label = (
        F.when(at < head, "preamble")
        .when(at == head, "header")
        .when(is_placeholder(cells), "placeholder")
        .when(is_summary(cells), "summary")
        .otherwise("data")
    )
    width = F.size("keys")
    ragged = F.when(F.size(cells) < width, "short").when(F.size(cells) > width, "long")
    return joined.withColumn("row_class", label).withColumn("ragged", F.when(F.col("row_class") == "data", ragged))


def keyed_rows(classified: DataFrame) -> DataFrame:
    """Data rows with dense index; short rows padded, long rows keep extras
    under positional keys."""
    width, n = F.size("keys"), F.size("cells")
    pad = F.array_repeat(F.lit(""), F.greatest(width - n, F.lit(0)))
    data = classified.where("row_class = 'data'").select(
        "file_id",
        "src_row",
        "row_block",
        F.concat("cells", pad).alias("cells"),
        F.when(n > width, F.concat(F.col("keys"), F.slice(positional_keys(n), width + 1, n)))
        .otherwise(F.col("keys"))
        .alias("keys"),
    )
    return dense_index(data, ["file_id"], "row_block", ["src_row"])


def as_map(rows: DataFrame) -> DataFrame:
    """Rows as ``map<key, cell>``; a repeated key keeps its last cell."""
    return rows.withColumn(
        "row", F.map_from_entries(F.array_distinct(F.arrays_zip(F.col("keys").alias("key"), F.col("cells").alias("value"))))
    )


def keying_issues(classified: DataFrame) -> DataFrame:
    what = (
        F.when(F.col("row_class") == "preamble", "preamble-row")
        .when(F.col("row_class") == "placeholder", "placeholder-row")
        .when(F.col("row_class") == "summary", "summary-row")
        .when(F.col("ragged") == "short", "ragged-short")
        .when(F.col("ragged") == "long", "ragged-long")
    )
    action = (
        F.when(F.col("ragged") == "short", "padded-row")
        .when(F.col("ragged") == "long", "truncated-row")
        .otherwise("skipped-row")
    )
    skipped = F.col("row_class") != "data"
    return classified.where(what.isNotNull()).select(
        "file_id",
        F.col("src_row").alias("row"),
        F.lit(None).cast("int").alias("column"),
        what.alias("what"),
        F.when(skipped, F.array_join("cells", "|")).alias("raw"),
        action.alias("action"),
    )


def all_issues(*parts: DataFrame) -> DataFrame:
    """One issue log; sort by ``file_id, row`` to read it (-1 is the file)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_meta(classified: DataFrame, delimiters: DataFrame, headers: DataFrame, encodings: DataFrame | None = None) -> DataFrame:
    """Counts and detected properties per file."""
    counts = classified.groupBy("file_id").agg(
        F.count_if(F.col("src_row") > F.col("header_row")).alias("total_rows"),
        F.count_if(F.col("row_class") == "data").alias("decoded_rows"),
    )
    meta = counts.join(headers.select("file_id", "header_row"), "file_id").join(delimiters, "file_id")
    return meta if encodings is None else meta.join(encodings, "file_id")


def schema_errors(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Files without rows of one common key set; of ``files``, also those without any row.

    Keyed rows always hold the header's keys, so the key sets differ exactly
    when the widths do.
    """
    widths = rows.groupBy("file_id").agg(F.min(F.size("keys")).alias("lo"), F.max(F.size("keys")).alias("hi"))
    mixed = widths.where("lo <> hi").select("file_id", F.lit("different-columns").alias("reason"))
    if files is None:
        return mixed
    empty = files.select("file_id").distinct().join(widths, "file_id", "left_anti")
    return mixed.unionByName(empty.select("file_id", F.lit("no-rows").alias("reason")))


def sample_cells(rows: DataFrame, at_most: int = 10) -> DataFrame:
    """Evenly spaced preview rows of each file, as cells."""
    sizes = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("file_rows"))
    n = F.least(F.col("file_rows"), F.lit(at_most))
    picked = rows.join(sizes, "file_id").where(in_even_sample(F.col("row_index"), F.col("file_rows"), n))
    return picked.select("file_id", "row_index", F.posexplode("cells").alias("col_id", "raw"))
