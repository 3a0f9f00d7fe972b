"""Queries on column mappings, typed cells, transactions and the review list.

The raw rows are statements written from ``lineitem``: one file per supplier,
thirteen text columns whose layout follows the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom.functions import currency as cur
from ledgerloom.functions import text as tx
from ledgerloom.functions.dates import date_part, parse_date_by
from ledgerloom.functions.indexing import block_of, dense_index
from ledgerloom.functions.numbers import parse_number
from ledgerloom.operators import columns as col
from ledgerloom.operators import detect, recall, review
from ledgerloom.operators import transactions as tr
from ledgerloom.plans.generation import Generated, generate
from ledgerloom.session import materialize
from ledgerloom.sources.tables import read_table, read_with_position
from ledgerloom.workload.adapters import BASE, TXN, txn
from ledgerloom.workload.registry import query, with_

NAMES = (
    "Date", "Amount", "Currency", "Details", "Note", "MCC", "Commission", "Cashback",
    "Status", "Counterparty", "Account", "Time", "Balance",
)


#: Columns of the joined tables that no cell is written from.
_MET = ("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "p_partkey", "s_suppkey", "src_row")


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``(file_id, src_row, row_block, row_index, cells)`` of the statements."""
    li = read_with_position(spark, sf, "lineitem").withColumn("_account", (F.col("l_orderkey") % 50).cast("int"))
    p = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    placed = joined.select(
        F.col("l_suppkey").alias("file_id"),
        "src_row",
        block_of(F.col("src_row")).alias("row_block"),
        *(c for c in joined.columns if c not in _MET),
    )
    # numbered before the cells are written: the columns are smaller than their texts
    rows = dense_index(placed, ["file_id"], "row_block", ["src_row"])
    day, layout = F.col("l_shipdate"), F.floor(F.col("s_nationkey") / 4) % 4
    outgoing = (F.col("l_returnflag") != "A") | (layout == 3)
    money = lambda c: F.translate(F.format_number(c, 4), ",.", " ,")
    code = F.get(F.array(*[F.lit(c) for c in ("UAH", "USD", "EUR", "GBP")]), F.col("s_nationkey") % 4)
    pick = lambda *vals: F.get(F.array(*[F.lit(v) for v in vals]), F.col("s_nationkey") % 4)
    date = (
        F.when(F.col("l_quantity") == 50, "n/a")
        .when(layout == 0, F.date_format(day, "dd.MM.yyyy HH:mm:ss"))
        .when(layout == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(layout == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(day, "dd/MM/yy"))
    )
    amount = F.when(F.col("l_quantity") == 49, "?").otherwise(
        F.concat(F.when(outgoing, "-").otherwise("+"), money("l_extendedprice"))
    )
    line = F.col("l_linenumber")
    currency = (
        F.when(line == 1, F.lower(code))
        .when(line == 2, pick("980", "840", "978", "826"))
        .when(line == 3, pick("₴", "$", "€", "£"))
        .otherwise(code)
    )
    cells = F.array(
        date,
        amount,
        currency,
        F.when(line == 4, "").otherwise(F.col("p_name")),
        F.when(F.col("l_returnflag") == "R", F.col("p_type")).otherwise(""),
        F.when(F.col("l_discount") == 0.1, "").otherwise(F.col("p_size").cast("string")),
        F.when(F.col("l_tax") == 0, "—").otherwise(F.format_number(F.col("l_extendedprice") * F.col("l_tax"), 4)),
        F.when(F.col("l_discount") == 0, "N/A").otherwise(
            F.concat(F.lit("+"), money(F.col("l_extendedprice") * F.col("l_discount")))
        ),
        F.when(F.col("l_quantity") <= 43, "OK").otherwise("FAILED"),
        F.col("s_name"),
        F.concat(F.lit("ACC"), F.col("_account").cast("string")),
        F.lit("10:00"),
        F.when((layout == 1) & (F.col("l_returnflag") != "R"), "xx").otherwise(money("l_extendedprice")),
    )
    return rows.select("file_id", "src_row", "row_block", cells.alias("cells"), "row_index")


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(raw_rows(spark, sf), "raw", compression="zstd")


RAW = """
li AS MATERIALIZED (SELECT *, row_number() OVER () - 1 AS src_row FROM lineitem),
raw AS MATERIALIZED (
  SELECT l_suppkey AS file_id, src_row, row_number() OVER (PARTITION BY l_suppkey ORDER BY src_row) - 1 AS row_index,
         CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price, l_quantity AS qty, l_returnflag AS flag, l_linenumber AS line,
         l_discount AS disc, l_tax AS tax, s_nationkey // 4 % 4 AS layout, s_nationkey AS nation, s_name, p_name, p_type, p_size, l_orderkey,
         (['UAH','USD','EUR','GBP'])[s_nationkey % 4 + 1] AS code, l_returnflag <> 'A' OR s_nationkey // 4 % 4 = 3 AS outgoing
  FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
cells AS MATERIALIZED (
  SELECT *, CASE WHEN qty = 50 THEN NULL ELSE day END AS c_date,
    CASE WHEN qty = 49 THEN NULL WHEN outgoing THEN -price ELSE price END AS c_amount,
    CASE WHEN line = 3 AND code = 'USD' THEN NULL ELSE code END AS c_currency,
    CASE WHEN line = 4 THEN NULL ELSE p_name END AS c_details,
    CASE WHEN flag = 'R' THEN p_type END AS c_note,
    CASE WHEN disc = 0.1 THEN NULL ELSE lpad(CAST(p_size AS VARCHAR), 4, '0') END AS c_mcc,
    CASE WHEN tax = 0 THEN NULL ELSE round(price * tax, 4) END AS c_commission,
    CASE WHEN disc = 0 THEN NULL ELSE round(price * disc, 4) END AS c_cashback,
    CASE WHEN qty <= 43 THEN 'OK' ELSE 'FAILED' END AS c_status,
    CASE WHEN layout = 1 AND flag <> 'R' THEN NULL ELSE price END AS c_balance,
    'ACC' || (l_orderkey % 50) AS c_account
  FROM raw),
kinds AS MATERIALIZED (
  SELECT file_id, CASE WHEN bool_or(c_amount > 0) AND bool_or(c_amount < 0) THEN 'mixed'
                       WHEN bool_or(c_amount <> 0) THEN 'outcome' ELSE 'income' END AS amount_type FROM cells GROUP BY file_id)
"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Column definitions per file; nation 24 maps a second DATE column,
    nation 23 leaves one column unmapped, nation 22 fixes the currency."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_nationkey")
    none = F.lit(None).cast("string")

    def entry(i: int, definition: Column, fmt=none, kind=none, mode=none, code=none, success=none) -> Column:
        return F.struct(
            F.lit(i).alias("col_id"),
            F.lit(NAMES[i]).alias("name"),
            definition.cast("string").alias("definition"),
            fmt.cast("string").alias("date_format"),
            kind.cast("string").alias("amount_type"),
            mode.cast("string").alias("currency_mode"),
            code.cast("string").alias("currency_code"),
            success.cast("string").alias("success_value"),
            F.lit("confirmed").alias("recall_state"),
        )

    nation = F.col("s_nationkey")
    auto = F.lit("auto")
    fixed = nation == 22
    items = [
        entry(0, F.lit(m.DATE), fmt=auto),
        entry(
            1,
            F.lit(m.AMOUNT),
            kind=auto,
            mode=F.when(fixed, "code").otherwise("auto"),
            code=F.when(fixed, "eur"),
        ),
        entry(2, F.lit(m.CURRENCY)),
        entry(3, F.lit(m.DESCRIPTION)),
        entry(4, F.lit(m.DESCRIPTION)),
        entry(5, F.lit(m.MERCHANT_CATEGORY)),
        entry(6, F.lit(m.BANK_COMMISSION), mode=F.lit("use_base")),
        entry(7, F.lit(m.CASHBACK), mode=F.lit("code"), code=F.lit("USD")),
        entry(8, F.lit(m.STATUS), success=auto),
        entry(9, F.lit(m.COUNTERPARTY)),
        entry(10, F.lit(m.BANK_ACCOUNT)),
        entry(11, F.when(nation == 24, m.DATE).when(nation != 23, m.TIME), fmt=F.when(nation == 24, "yyyy-MM-dd")),
        entry(12, F.lit(m.BALANCE), mode=auto),
    ]
    return s.select("file_id", F.explode(F.array(*items)).alias("e")).select("file_id", "e.*")


def typed(spark: SparkSession, sf: str) -> DataFrame:
    """Typed rows under the resolved mapping."""
    rows = stored_rows(spark, sf)
    resolved = materialize(detect.resolve_auto(rows, mapping(spark, sf)), "mapping")
    return col.typed_rows(rows, col.file_columns(resolved))


def cell(i: int, field: str) -> Column:
    return F.try_element_at(F.filter("typed", lambda c: c["col_id"] == i), F.lit(1))["v"][field]


def typed_column(spark: SparkSession, sf: str, i: int) -> DataFrame:
    """Typed rows with one described column."""
    rows = stored_rows(spark, sf)
    wanted = mapping(spark, sf).where(F.col("col_id") == i)
    return col.typed_rows(rows, col.file_columns(detect.resolve_auto(rows, wanted)))


# ------------------------------------------------------------- E1-E5, H5, I1-I4


@query(
    "H5_even_sample",
    with_(
        RAW,
        """, n AS (SELECT file_id, count(*) AS total, least(count(*), greatest(least(ceil(count(*) * 10 / 100.0), 1000), least(count(*), 100)))::BIGINT AS size FROM raw GROUP BY file_id),
pick AS (SELECT file_id, (i * total) // size AS row_index FROM n, range(1000) t(i) WHERE i < size)
SELECT file_id, row_index FROM pick""",
    ),
)
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return detect.even_sample(stored_rows(spark, sf)).select("file_id", "row_index")


_FORMAT_SQL = "CASE layout WHEN 0 THEN 'dd.MM.yyyy' WHEN 1 THEN 'MM/dd/yyyy' WHEN 2 THEN 'yyyy-MM-dd' ELSE 'dd/MM/yy' END"
@query(
    "E1_date_formats",
    with_(
        RAW,
        f"""SELECT file_id, 0 AS col_id, {_FORMAT_SQL} AS date_format, round(count(*) FILTER (WHERE qty <> 50) * 100.0 / count(*), 6)::DOUBLE AS percent
FROM raw GROUP BY file_id, layout HAVING count(*) FILTER (WHERE qty <> 50) * 100.0 / count(*) >= 90""",
    ),
)
def e1(spark: SparkSession, sf: str) -> DataFrame:
    cells = detect.cells_of(stored_rows(spark, sf))
    formats = detect.date_formats(detect.date_candidates(cells, detect.column_sketches(cells)))
    return formats.withColumn("percent", F.round("percent", 6))


@query(
    "E2_sign_census",
    with_(RAW, "SELECT file_id, count(*) FILTER (WHERE c_amount > 0) AS positive, count(*) FILTER (WHERE c_amount < 0) AS negative, any_value(amount_type) AS amount_type FROM cells JOIN kinds USING (file_id) GROUP BY file_id"),
)
def e2(spark: SparkSession, sf: str) -> DataFrame:
    amounts = raw_rows(spark, sf).select("file_id", F.lit(1).alias("col_id"), F.get("cells", F.lit(1)).alias("raw"))
    return detect.sign_census(amounts).drop("col_id")


@query(
    "E3_dominant_status",
    with_(RAW, "SELECT file_id, 'OK' AS value, round(count(*) FILTER (WHERE qty <= 43) / count(*)::DOUBLE, 9) AS share FROM raw GROUP BY file_id HAVING count(*) FILTER (WHERE qty <= 43) / count(*) >= 0.8"),
)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    cells = raw_rows(spark, sf).select("file_id", "row_index", F.lit(8).alias("col_id"), F.get("cells", F.lit(8)).alias("raw"))
    return detect.dominant_status(cells).select("file_id", "value", F.round("share", 9).alias("share"))


@query(
    "E4_auto_detection",
    with_(
        RAW,
        f""", d AS (SELECT file_id FROM raw GROUP BY file_id, layout HAVING count(*) FILTER (WHERE qty <> 50) * 100.0 / count(*) >= 90),
vals AS (
  SELECT file_id, col_id, val, count(*) AS n FROM (
   SELECT file_id, 4 AS col_id, coalesce(c_note, '') AS val FROM cells UNION ALL SELECT file_id, 8, c_status FROM cells UNION ALL SELECT file_id, 9, s_name FROM cells
   UNION ALL SELECT file_id, 11, '10:00' FROM cells
   UNION ALL SELECT file_id, 2, CASE line WHEN 1 THEN lower(code) WHEN 2 THEN code || 'num' WHEN 3 THEN code || 'sym' ELSE code END FROM cells
   UNION ALL SELECT file_id, 6, CAST(c_commission AS VARCHAR) FROM cells UNION ALL SELECT file_id, 7, CAST(c_cashback AS VARCHAR) FROM cells) GROUP BY ALL)
SELECT file_id, 0 AS col_id, '{m.DATE}' AS definition FROM d
UNION ALL SELECT file_id, col_id, '{m.STATUS}' FROM vals GROUP BY file_id, col_id HAVING sum(n) >= 10 AND count(*) <= 10 AND max(n) / sum(n) >= 0.8""",
    ),
)
def e4(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_rows(spark, sf)
    return detect.auto_detect(detect.cells_of(rows)).select("file_id", "col_id", "definition")


@query(
    "I1_parse_number",
    with_(RAW, "SELECT src_row, round(c_amount, 4) AS amount, c_commission AS commission, c_cashback AS cashback FROM cells"),
)
def i1(spark: SparkSession, sf: str) -> DataFrame:
    value = lambda i: F.round(parse_number(F.get("cells", F.lit(i))), 4)
    return raw_rows(spark, sf).select(
        "src_row", value(1).alias("amount"), value(6).alias("commission"), value(7).alias("cashback")
    )


@query(
    "I2_null_like",
    with_(RAW, "SELECT file_id, count(*) FILTER (WHERE tax = 0) AS no_commission, count(*) FILTER (WHERE disc = 0) AS no_cashback, count(*) FILTER (WHERE line = 4) AS no_details FROM raw GROUP BY file_id"),
)
def i2(spark: SparkSession, sf: str) -> DataFrame:
    empty = lambda i: F.count_if(tx.is_null_like(F.get("cells", F.lit(i))))
    return raw_rows(spark, sf).groupBy("file_id").agg(
        empty(6).alias("no_commission"), empty(7).alias("no_cashback"), empty(3).alias("no_details")
    )


@query(
    "I3_date_part",
    with_(RAW, "SELECT src_row, CASE WHEN qty = 50 THEN 'n/a' WHEN layout = 0 THEN strftime(day, '%d.%m.%Y') WHEN layout = 1 THEN strftime(day, '%m/%d/%Y') WHEN layout = 2 THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%d/%m/%y') END AS date_text FROM raw"),
)
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return raw_rows(spark, sf).select("src_row", date_part(F.get("cells", F.lit(0))).alias("date_text"))


@query(
    "I4_parse_date",
    with_(RAW, f"SELECT src_row, CASE WHEN layout < 3 OR year(day) >= 2000 THEN c_date WHEN c_date IS NOT NULL THEN c_date + INTERVAL 100 YEAR END::DATE AS date, {_FORMAT_SQL} AS fmt FROM cells"),
)
def i4(spark: SparkSession, sf: str) -> DataFrame:
    """Every date with its file's format; two-digit years are 2000-based."""
    s = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("file_id"), (F.floor(F.col("s_nationkey") / 4) % 4).alias("layout")
    )
    fmt = F.get(F.array(*[F.lit(f) for f in ("dd.MM.yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd/MM/yy")]), F.col("layout").cast("int"))
    rows = raw_rows(spark, sf).join(s, "file_id").withColumn("fmt", fmt)
    return rows.select("src_row", parse_date_by(F.get("cells", F.lit(0)), F.col("fmt")).alias("date"), "fmt")


# ------------------------------------------------------------------ B0-B17

_ERRORS = """errs AS (
  SELECT file_id, col_id, definition, count(*) AS total, count(*) FILTER (WHERE bad) AS errors FROM (
    SELECT file_id, 0 AS col_id, 'DATE' AS definition, c_date IS NULL AS bad FROM cells
    UNION ALL SELECT file_id, 1, 'AMOUNT', c_amount IS NULL FROM cells UNION ALL SELECT file_id, 2, 'CURRENCY', c_currency IS NULL FROM cells
    UNION ALL SELECT file_id, 3, 'DESCRIPTION', FALSE FROM cells UNION ALL SELECT file_id, 4, 'DESCRIPTION', FALSE FROM cells
    UNION ALL SELECT file_id, 5, 'MERCHANT_CATEGORY', c_mcc IS NULL FROM cells UNION ALL SELECT file_id, 6, 'BANK_COMMISSION', FALSE FROM cells
    UNION ALL SELECT file_id, 7, 'CASHBACK', FALSE FROM cells UNION ALL SELECT file_id, 8, 'STATUS', FALSE FROM cells
    UNION ALL SELECT file_id, 9, 'COUNTERPARTY', FALSE FROM cells UNION ALL SELECT file_id, 10, 'BANK_ACCOUNT', FALSE FROM cells
    UNION ALL SELECT file_id, 11, CASE nation WHEN 24 THEN 'DATE' WHEN 23 THEN NULL ELSE 'TIME' END, nation = 24 FROM cells
    UNION ALL SELECT file_id, 12, 'BALANCE', c_balance IS NULL FROM cells)
  GROUP BY ALL)"""


@query(
    "B0_column_error_gate",
    with_(RAW + ", " + _ERRORS, "SELECT file_id, col_id, definition, total, errors, errors / total > 0.3 AS rejected FROM errs"),
)
def b0(spark: SparkSession, sf: str) -> DataFrame:
    return col.column_errors(typed(spark, sf)).drop("error_ratio")


@query(
    "B0_rejection_details",
    with_(
        RAW,
        """SELECT file_id, row_index, 12 AS col_id, 'xx' AS raw FROM cells JOIN (SELECT file_id FROM cells GROUP BY file_id HAVING count(*) FILTER (WHERE c_balance IS NULL) / count(*) > 0.3) USING (file_id) WHERE c_balance IS NULL
UNION ALL SELECT file_id, row_index, 11, '10:00' FROM cells WHERE nation = 24""",
    ),
)
def b0_details(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(typed(spark, sf), "typed", compression="zstd")
    return col.rejection_details(rows, col.column_errors(rows)).select("file_id", "row_index", "col_id", "raw")


def _typed_query(name: str, sql: str, i: int, build) -> None:
    query(name, with_(RAW, sql))(lambda spark, sf: build(typed_column(spark, sf, i)))


_YEAR2000 = "CASE WHEN layout < 3 OR year(c_date) >= 2000 THEN c_date WHEN c_date IS NOT NULL THEN c_date + INTERVAL 100 YEAR END::DATE"
_typed_query(
    "B1_date_column",
    f"SELECT src_row, {_YEAR2000} AS date, CASE WHEN c_date IS NULL THEN 'date-parse-failed' END AS error FROM cells",
    0,
    lambda d: d.select("src_row", cell(0, "date").alias("date"), cell(0, "error").alias("error")),
)
_typed_query(
    "B2_amount_column",
    """SELECT src_row, abs(c_amount) AS amount, CASE WHEN amount_type = 'mixed' AND c_amount > 0 THEN 'positive-value-ignored' END AS ignored,
 CASE WHEN c_amount IS NULL THEN 'amount-parse-failed' END AS error FROM cells JOIN kinds USING (file_id)""",
    1,
    lambda d: d.select("src_row", cell(1, "number").alias("amount"), cell(1, "ignore").alias("ignored"), cell(1, "error").alias("error")),
)
_typed_query(
    "B3_currency_column",
    "SELECT src_row, c_currency AS currency, CASE WHEN c_currency IS NULL THEN 'currency-ambiguous' END AS error FROM cells",
    2,
    lambda d: d.select("src_row", cell(2, "text").alias("currency"), cell(2, "error").alias("error")),
)
for _name, _i, _expr in (
    ("B4_description_column", 3, "c_details"),
    ("B7_account_column", 10, "c_account"),
    ("B14_counterparty_column", 9, "s_name"),
):
    _typed_query(
        _name,
        f"SELECT src_row, {_expr} AS text FROM cells",
        _i,
        lambda d, i=_i: d.select("src_row", cell(i, "text").alias("text")),
    )
for _name, _i, _expr in (
    ("B6_balance_column", 12, "c_balance"),
    ("B10_commission_column", 6, "c_commission"),
    ("B11_cashback_column", 7, "c_cashback"),
):
    _typed_query(
        _name,
        f"SELECT src_row, round({_expr}, 4) AS number, {'CASE WHEN c_balance IS NULL THEN ' + chr(39) + 'number-parse-failed' + chr(39) + ' END' if _i == 12 else 'CAST(NULL AS VARCHAR)'} AS error FROM cells",
        _i,
        lambda d, i=_i: d.select("src_row", F.round(cell(i, "number"), 4).alias("number"), cell(i, "error").alias("error")),
    )
_typed_query(
    "B8_status_column",
    """SELECT src_row, CASE WHEN c_status <> 'OK' OR file_id NOT IN (SELECT file_id FROM cells GROUP BY file_id HAVING count(*) FILTER (WHERE qty <= 43) / count(*) >= 0.8)
 THEN 'status-value-ignored' END AS ignored FROM cells""",
    8,
    lambda d: d.select("src_row", cell(8, "ignore").alias("ignored")),
)
_typed_query(
    "B12_merchant_column",
    "SELECT src_row, c_mcc AS mcc, CASE WHEN c_mcc IS NULL THEN 'merchant-parse-failed' END AS error FROM cells",
    5,
    lambda d: d.select("src_row", cell(5, "text").alias("mcc"), cell(5, "error").alias("error")),
)
_typed_query(
    "B13_time_column_dropped",
    "SELECT file_id, count(*) AS rows_, 0::BIGINT AS kept FROM cells WHERE nation NOT IN (23, 24) GROUP BY file_id",
    11,
    lambda d: d.where(F.get("cols", F.lit(0))["definition"] == m.TIME)
    .groupBy("file_id")
    .agg(F.count(F.lit(1)).alias("rows_"), F.count(F.coalesce(cell(11, "text"), cell(11, "date").cast("string"), cell(11, "error"))).alias("kept")),
)


def _remapped(spark: SparkSession, sf: str, changes: dict[int, str], also: tuple[int, ...] = ()) -> DataFrame:
    """Typed rows with some columns mapped to other definitions."""
    rows = raw_rows(spark, sf)
    changed = F.coalesce(*[F.when(F.col("col_id") == i, d) for i, d in changes.items()], F.col("definition"))
    wanted = mapping(spark, sf).where(F.col("col_id").isin(*changes, *also))
    return col.typed_rows(rows, col.file_columns(wanted.withColumn("definition", changed)))


@query("B5_category_column", with_(RAW, "SELECT src_row, c_note AS bank_category FROM cells"))
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return _remapped(spark, sf, {4: m.CATEGORY}).select("src_row", cell(4, "text").alias("bank_category"))


@query("B9_exchange_rate_column", with_(RAW, "SELECT src_row, round(c_commission, 4) AS rate FROM cells"))
def b9(spark: SparkSession, sf: str) -> DataFrame:
    return _remapped(spark, sf, {6: m.EXCHANGE_RATE}).select("src_row", F.round(cell(6, "number"), 4).alias("rate"))


@query("B15_ignored_column", with_(RAW, "SELECT file_id, count(*) AS rows_, 0::BIGINT AS kept FROM raw GROUP BY file_id"))
def b15(spark: SparkSession, sf: str) -> DataFrame:
    rows = _remapped(spark, sf, {9: m.IGNORE})
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows_"), F.count(cell(9, "text")).alias("kept"))


@query(
    "B16_unmapped_columns",
    "SELECT s_suppkey AS file_id, 11 AS col_id, 'Time' AS name FROM supplier WHERE s_nationkey = 23",
)
def b16(spark: SparkSession, sf: str) -> DataFrame:
    return col.unmapped_columns(mapping(spark, sf))


@query(
    "B17_reset_columns",
    "SELECT s_suppkey AS file_id, count(*) FILTER (WHERE c NOT IN (12) AND NOT (c = 11 AND s_nationkey = 23)) AS mapped FROM supplier, range(13) r(c) GROUP BY s_suppkey",
)
def b17(spark: SparkSession, sf: str) -> DataFrame:
    """Reset the balance column of every file."""
    m0 = mapping(spark, sf)
    undone = col.reset_column(m0, m0.where("name = 'Balance'").select("file_id", "col_id"))
    return undone.groupBy("file_id").agg(F.count("definition").alias("mapped"))


# ------------------------------------------------------- B20-B28, E23, reviews

OPS = RAW + ", " + _ERRORS + f""",
refused AS MATERIALIZED (
  SELECT file_id, col_id, 'column-rejected' AS reason FROM errs WHERE errors / total > 0.3
  UNION ALL SELECT s_suppkey, 11, 'column-unmapped' FROM supplier WHERE s_nationkey = 23
  UNION ALL SELECT s_suppkey, NULL, 'structural-multiple-date-columns' FROM supplier WHERE s_nationkey = 24
  UNION ALL SELECT file_id, 8, 'no-dominant-status-value' FROM cells GROUP BY file_id
    HAVING greatest(count(*) FILTER (WHERE qty <= 43), count(*) FILTER (WHERE qty > 43)) / count(*) < 0.8),
good AS MATERIALIZED (
  SELECT c.*, k.amount_type, CASE WHEN nation = 22 THEN 'EUR' ELSE c_currency END AS currency
  FROM cells c JOIN kinds k USING (file_id) WHERE file_id NOT IN (SELECT file_id FROM refused)),
main AS MATERIALIZED (
  SELECT *, CASE WHEN amount_type = 'mixed' AND c_amount > 0 THEN 'positive-value-ignored' END AS skip,
    CASE WHEN c_date IS NULL THEN 'date-parse-failed' WHEN c_amount IS NULL THEN 'amount-parse-failed' WHEN currency IS NULL THEN 'currency-ambiguous' END AS err
  FROM good),
ops AS MATERIALIZED (
  SELECT file_id, row_index AS source_row, 'main' AS kind, 0 AS kind_order, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN err IS NOT NULL THEN 'error' ELSE 'ok' END AS state,
         coalesce(skip, err) AS reason, abs(c_amount) AS amount, currency, nullif(concat_ws(' ', c_details, c_note), '') AS description_, c_account AS account, {_YEAR2000} AS date, c_mcc AS mcc,
         concat_ws(' ', c_details, c_note) AS description FROM main
  UNION ALL SELECT file_id, row_index, 'commission', 1, CASE WHEN c_date IS NULL THEN 'error' ELSE 'ok' END, CASE WHEN c_date IS NULL THEN 'no-date' END, c_commission, '{BASE}', NULL, c_account, {_YEAR2000}, NULL, 'Bank commission'
  FROM main WHERE (skip IS NOT NULL OR err IS NULL) AND c_commission IS NOT NULL
  UNION ALL SELECT file_id, row_index, 'cashback', 2, CASE WHEN c_date IS NULL THEN 'error' ELSE 'ok' END, CASE WHEN c_date IS NULL THEN 'no-date' END, c_cashback, 'USD', NULL, c_account, {_YEAR2000}, NULL, 'Cashback'
  FROM main WHERE (skip IS NOT NULL OR err IS NULL) AND c_cashback IS NOT NULL)
"""


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Per-file columns, amount choice included, without structural errors."""
    rows = stored_rows(spark, sf)
    resolved = detect.resolve_auto(rows, mapping(spark, sf))
    return materialize(tr.with_amount_choice(col.file_columns(resolved), BASE), "choices")


def generated(spark: SparkSession, sf: str) -> Generated:
    rows = stored_rows(spark, sf)
    return generate(rows, mapping(spark, sf), BASE)


def typed_choice(spark: SparkSession, sf: str) -> DataFrame:
    return generated(spark, sf).typed


def operations(spark: SparkSession, sf: str) -> DataFrame:
    return tr.operations(typed_choice(spark, sf), BASE)


def stored_operations(rows: DataFrame) -> DataFrame:
    return materialize(tr.operations(rows, BASE), "ops", compression="zstd")


@query(
    "B20_generated_operations",
    with_(OPS, "SELECT file_id, source_row, kind, state, reason, CASE WHEN state <> 'error' OR kind <> 'main' THEN round(amount, 4) END AS amount, CASE WHEN state = 'ok' THEN date END AS date, mcc FROM ops"),
)
def b20(spark: SparkSession, sf: str) -> DataFrame:
    shown = (F.col("state") != "error") | (F.col("kind") != "main")
    return operations(spark, sf).select(
        "file_id",
        "source_row",
        "kind",
        "state",
        "reason",
        F.when(shown, F.round("amount", 4)).alias("amount"),
        F.when(F.col("state") == "ok", F.col("date")).alias("date"),
        "mcc",
    )


@query("B21_structural_errors", "SELECT s_suppkey AS file_id, 'structural-multiple-date-columns' AS reason FROM supplier WHERE s_nationkey = 24")
def b21(spark: SparkSession, sf: str) -> DataFrame:
    return tr.structural_errors(col.file_columns(mapping(spark, sf)))


@query("B16_refused_files", with_(OPS, "SELECT * FROM refused"))
def b16_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason that keeps a file from generating rows."""
    return generated(spark, sf).refused


@query("B22_skipped_rows", with_(OPS, "SELECT file_id, source_row, reason FROM ops WHERE state = 'skipped'"))
def b22(spark: SparkSession, sf: str) -> DataFrame:
    return tr.skipped_rows(operations(spark, sf))


@query("B23_joined_texts", with_(OPS, "SELECT file_id, source_row, description, account FROM ops WHERE kind = 'main'"))
def b23(spark: SparkSession, sf: str) -> DataFrame:
    return operations(spark, sf).where("kind = 'main'").select("file_id", "source_row", "description", "account")


@query("B24_first_columns", with_(RAW, "SELECT file_id, row_index, c_mcc AS mcc, c_note AS bank_category FROM cells"))
def b24(spark: SparkSession, sf: str) -> DataFrame:
    rows = _remapped(spark, sf, {4: m.CATEGORY, 10: m.CATEGORY}, also=(5,))
    return rows.select(
        "file_id", "row_index", tr.first_text(m.MERCHANT_CATEGORY).alias("mcc"), tr.first_text(m.CATEGORY).alias("bank_category")
    )


@query(
    "B25_single_amount_choice",
    "SELECT s_suppkey AS file_id, 1 AS amount_col, CASE WHEN s_nationkey = 22 THEN NULL ELSE 2 END AS currency_col, CASE WHEN s_nationkey = 22 THEN 'EUR' END AS currency_fixed FROM supplier",
)
def b25(spark: SparkSession, sf: str) -> DataFrame:
    return choices(spark, sf).select("file_id", "amount_col", "currency_col", "currency_fixed")


@query(
    "B26_several_amount_choice",
    """SELECT s_suppkey AS file_id,
 CASE s_nationkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 6 WHEN 2 THEN 7 WHEN 3 THEN 6 ELSE 1 END AS amount_col,
 CASE s_nationkey % 5 WHEN 1 THEN 2 END AS currency_col,
 CASE s_nationkey % 5 WHEN 0 THEN 'EUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'EUR' END AS currency_fixed,
 CASE s_nationkey % 5 WHEN 4 THEN 'undetermined-amount' END AS choice_error FROM supplier""",
)
def b26(spark: SparkSession, sf: str) -> DataFrame:
    """Three AMOUNT columns per file; which one counts follows the nation:
    income and outcome pair, automatic currency, USD code, base code, none."""
    case = F.col("s_nationkey") % 5
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), "s_nationkey")
    m0 = mapping(spark, sf).join(s, "file_id")
    i = F.col("col_id")
    amounts = i.isin(1, 6, 7)
    kind = F.when((case == 0) & (i == 1), "income").when((case == 0) & (i == 6), "outcome")
    mode = (
        F.when(case == 0, F.when(i == 6, "use_base").otherwise("code"))
        .when((case == 1) & (i == 6), "auto")
        .when(case == 4, F.lit(None))
        .otherwise("code")
    )
    code = (
        F.when((case == 2) & (i == 7), "USD")
        .when((case == 3) & (i == 6), BASE)
        .when((case == 2) | (case == 3), "GBP")
    )
    changed = m0.select(
        "file_id",
        "col_id",
        "name",
        F.when(amounts, m.AMOUNT).otherwise(F.col("definition")).alias("definition"),
        "date_format",
        F.when(amounts, kind).alias("amount_type"),
        F.when(amounts, mode).alias("currency_mode"),
        F.when(amounts, code).alias("currency_code"),
        "success_value",
        "recall_state",
    )
    chosen = tr.with_amount_choice(col.file_columns(changed), BASE)
    return chosen.select("file_id", "amount_col", "currency_col", "currency_fixed", "choice_error")


@query("B27_pseudo_operations", with_(OPS, "SELECT file_id, source_row, kind, state, reason, round(amount, 4) AS amount, currency, description FROM ops WHERE kind <> 'main'"))
def b27(spark: SparkSession, sf: str) -> DataFrame:
    return operations(spark, sf).where("kind <> 'main'").select(
        "file_id", "source_row", "kind", "state", "reason", F.round("amount", 4).alias("amount"), "currency", "description"
    )


@query(
    "B28_transaction_index",
    with_(OPS, "SELECT file_id, source_row, kind, row_number() OVER (PARTITION BY file_id ORDER BY source_row, kind_order) - 1 AS row_index FROM ops WHERE state = 'ok'"),
)
def b28(spark: SparkSession, sf: str) -> DataFrame:
    return tr.transactions(stored_operations(typed_choice(spark, sf))).select("file_id", "source_row", "kind", "row_index")


@query("E23_kind_counts", with_(OPS, "SELECT kind, state, count(*) AS n FROM ops GROUP BY kind, state"))
def e23(spark: SparkSession, sf: str) -> DataFrame:
    return tr.kind_counts(operations(spark, sf))


@query(
    "B30_review_echo",
    with_(
        OPS,
        f"""SELECT file_id, row_index, round(abs(c_amount), 4) AS amount, c_currency AS currency, c_details AS description, CASE WHEN c_date IS NOT NULL THEN {_YEAR2000} END AS date
FROM (SELECT *, unnest(range(CAST(skip IS NULL AND err IS NOT NULL AS INTEGER) + CASE WHEN skip IS NOT NULL AND c_date IS NULL THEN
  CAST(c_commission IS NOT NULL AS INTEGER) + CAST(c_cashback IS NOT NULL AS INTEGER) ELSE 0 END)) AS copy FROM main)""",
    ),
)
def b30(spark: SparkSession, sf: str) -> DataFrame:
    rows = typed_choice(spark, sf)
    out = review.other_rows(tr.operations(rows, BASE), rows, "error")
    return out.select("file_id", "row_index", F.round("amount", 4).alias("amount"), "currency", "description", "date")


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """The review of a second import: what has a commission counts as stored."""
    rows = typed_choice(spark, sf)
    ops = stored_operations(rows)
    kept = tr.transactions(ops).withColumn("category_id", F.when(F.col("mcc") == "0011", "food"))
    kept = kept.withColumn("is_manual", F.lit(0)).withColumn("dup", F.col("kind") == "commission")
    return review.review(kept, ops, rows)


_REVIEW = OPS + """,
rv AS (
  SELECT file_id, state, reason,
         CASE WHEN state = 'ok' THEN row_number() OVER (PARTITION BY file_id, state = 'ok' ORDER BY source_row, kind_order) - 1 ELSE source_row END AS row_index,
         CASE WHEN state = 'ok' THEN amount ELSE max(amount) FILTER (WHERE kind = 'main') OVER (PARTITION BY file_id, source_row) END AS amount,
         CASE WHEN state = 'ok' THEN kind = 'commission' END AS dup, CASE WHEN state = 'ok' AND mcc = '0011' THEN 'food' END AS category_id FROM ops)
"""


@query("J1_review_union", with_(_REVIEW, "SELECT file_id, row_index, state, round(amount, 4) AS amount, dup, category_id, reason FROM rv"))
def j1(spark: SparkSession, sf: str) -> DataFrame:
    return reviewed(spark, sf).select("file_id", "row_index", "state", F.round("amount", 4).alias("amount"), "dup", "category_id", "reason")


@query("B31_review_shapes", with_(_REVIEW, "SELECT state, count(*) AS n, count(amount) AS amounts, count(dup) AS dups, count(category_id) AS categories, count(reason) AS reasons FROM rv GROUP BY state"))
def b31(spark: SparkSession, sf: str) -> DataFrame:
    return reviewed(spark, sf).groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("amount").alias("amounts"),
        F.count("dup").alias("dups"),
        F.count("category_id").alias("categories"),
        F.count("reason").alias("reasons"),
    )


@query(
    "E10_review_summary",
    with_(_REVIEW, "SELECT file_id, count(*) AS total, count(*) FILTER (WHERE state = 'ok') AS ok, count(*) FILTER (WHERE state = 'error') AS error, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'ok' AND dup) AS dup, count(*) FILTER (WHERE state = 'ok' AND NOT dup) AS new_count FROM rv GROUP BY file_id"),
)
def e10(spark: SparkSession, sf: str) -> DataFrame:
    return review.summary(reviewed(spark, sf))


@query("C36_review_filter", with_(OPS, "SELECT file_id, source_row AS row_index, state, reason FROM ops WHERE state IN ('error', 'skipped')"))
def c36(spark: SparkSession, sf: str) -> DataFrame:
    return review.by_state(reviewed(spark, sf), ["error", "skipped"]).select("file_id", "row_index", "state", "reason")


@query(
    "H1_filtered_page",
    with_(
        TXN,
        """, f AS (SELECT file_id, src_row, row_number() OVER (PARTITION BY file_id ORDER BY src_row) - 1 AS row_index, count(*) OVER (PARTITION BY file_id) AS total FROM txn WHERE bank_category = 'PROMO')
SELECT file_id, src_row, row_index, total FROM f WHERE row_index BETWEEN 5 AND 14""",
    ),
)
def h1(spark: SparkSession, sf: str) -> DataFrame:
    hits = txn(spark, sf).where("bank_category = 'PROMO'")
    indexed = dense_index(hits, ["file_id"], "row_block", ["src_row"])
    totals = hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    return review.page(indexed, 5, 10).join(totals, "file_id").select("file_id", "src_row", "row_index", "total")


# --------------------------------------------------------------- D8-D10, E5, I15


def text_words(spark: SparkSession, sf: str) -> DataFrame:
    """All words of all documents, one row each."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", "lang", "source", "n_chars", F.explode(F.split("text", "[ \n]")).alias("name"))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Remembered headers: the words that start a line of any document."""
    d = read_table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    first = d.groupBy(F.split("line", " ")[0].alias("name")).agg(F.max("lang").alias("lang"))
    d = first.groupBy(tx.normalize_key(F.col("name")).alias("column_name")).agg(F.max("lang").alias("lang"))
    params = F.struct(F.lit("auto").alias("format"))
    return d.where("column_name is not null").select(
        "column_name", F.when(F.col("lang") == "en", m.DATE).otherwise(m.DESCRIPTION).alias("definition"), params.alias("params")
    )


def header_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of whole texts as headers of a file per source."""
    return text_words(spark, sf).select(F.col("source").alias("file_id"), "name")


_KEY = "nfc_normalize(trim({}, ' ' || chr(9) || chr(13) || chr(160)))"
_POOL = f"""
words AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS name FROM documents),
hk AS (SELECT source AS file_id, name, {_KEY.format("name")} AS key FROM words),
starts AS (SELECT lang, string_split(unnest(string_split(text, chr(10))), ' ')[1] AS name FROM documents),
pool AS (SELECT {_KEY.format("name")} AS key, CASE WHEN max(lang) = 'en' THEN 'DATE' ELSE 'DESCRIPTION' END AS definition FROM starts GROUP BY 1)
"""


@query("D8_recall", with_(_POOL, "SELECT file_id, name, definition, CASE WHEN definition IS NOT NULL THEN 'guessed' END AS recall_state, count(*) AS n FROM hk LEFT JOIN pool USING (key) GROUP BY ALL"))
def d8(spark: SparkSession, sf: str) -> DataFrame:
    found = recall.recall(header_words(spark, sf), pool(spark, sf))
    return found.groupBy("file_id", "name", "definition", "recall_state").agg(F.count(F.lit(1)).alias("n"))


@query("E5_recognized_columns", with_(_POOL, "SELECT file_id, count(DISTINCT CASE WHEN definition IS NOT NULL THEN key END) AS recognized, count(*) AS columns FROM hk LEFT JOIN pool USING (key) GROUP BY file_id"))
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return recall.recognized(recall.recall(header_words(spark, sf), pool(spark, sf)))


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """New mappings for all words of all documents."""
    d = text_words(spark, sf).groupBy("name").agg(F.max("n_chars").alias("n"))
    d = d.groupBy(tx.normalize_key(F.col("name")).alias("key")).agg(F.max("n").alias("n"))
    fmt = F.when(F.col("n") > 2000, "yyyy-MM-dd").otherwise("auto")
    return d.select("key", F.lit(m.DATE).alias("definition"), F.struct(fmt.alias("format")).alias("params"))


_INCOMING = _POOL + f""", inc AS (SELECT {_KEY.format("name")} AS key, max(n_chars) AS n FROM words GROUP BY 1)
"""


@query("D9_recall_collisions", with_(_INCOMING, "SELECT key, CASE WHEN definition <> 'DATE' THEN 'type-change' ELSE 'params-change' END AS collision FROM inc JOIN pool USING (key) WHERE definition <> 'DATE' OR n > 2000"))
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return recall.collisions(incoming(spark, sf), pool(spark, sf)).select("key", "collision")


@query("D9_recall_save_new", with_(_INCOMING, "SELECT key AS column_name, definition FROM pool UNION ALL SELECT key, 'DATE' FROM inc WHERE key NOT IN (SELECT key FROM pool)"))
def d9_save(spark: SparkSession, sf: str) -> DataFrame:
    return recall.save_new(pool(spark, sf), incoming(spark, sf)).select("column_name", "definition")


@query(
    "D10_recall_confirm",
    with_(
        _POOL,
        f""", w AS (SELECT {_KEY.format("name")} AS key, arg_max(lang, doc_id) AS definition FROM words GROUP BY 1)
SELECT key AS column_name, definition FROM w UNION ALL SELECT key, definition FROM pool WHERE key NOT IN (SELECT key FROM w)""",
    ),
)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    """Every document confirms its words; the latest document wins."""
    newest = text_words(spark, sf).groupBy("name").agg(F.max(F.struct("doc_id", "lang")).alias("d"))
    writes = newest.select(
        tx.normalize_key(F.col("name")).alias("column_name"),
        F.col("d.lang").alias("definition"),
        F.struct(F.lit("auto").alias("format")).alias("params"),
        F.col("d.doc_id").alias("updated_at"),
    )
    return recall.confirm(pool(spark, sf), writes).select("column_name", "definition")


@query("I15_params_equality", with_(_INCOMING, "SELECT key, n <= 2000 AS same_params FROM inc JOIN pool USING (key)"))
def i15(spark: SparkSession, sf: str) -> DataFrame:
    old = pool(spark, sf).select(F.col("column_name").alias("key"), F.col("params").alias("old"))
    return incoming(spark, sf).join(old, "key").select("key", F.col("params").eqNullSafe(F.col("old")).alias("same_params"))


# -------------------------------------------------------- currency, labels, D14

_CUR = "cur(code, numeric_code, digits, en, uk) AS (VALUES " + ", ".join(
    f"('{c[0]}', {c[1]}, {c[2]}, '{c[3]}', '{c[4]}')" for c in cur.CURRENCIES
) + ")"


@query(
    "I9_currency_lookup",
    with_(RAW, "SELECT code AS iso, line, count(*) AS n FROM raw GROUP BY ALL"),
)
def i9(spark: SparkSession, sf: str) -> DataFrame:
    """Codes, numeric codes and symbols of the statements back to ISO codes
    (symbols by their first claim, so the dollar sign is not USD's alone)."""
    li = read_table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber")
    s = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    pick = lambda *vals: F.get(F.array(*[F.lit(v) for v in vals]), F.col("s_nationkey") % 4)
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, pick("UAH", "USD", "EUR", "GBP"))
        .when(line == 2, pick("980", "840", "978", "826"))
        .otherwise(pick("₴", "$", "€", "£"))
    )
    maps = cur.lookup_maps()
    iso = F.coalesce(cur.symbol_to_iso(text, maps), cur.get(maps["numeric"], text))
    rows = li.join(s, li.l_suppkey == s.s_suppkey)
    return rows.groupBy(iso.alias("iso"), line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "I10_resolve_currency",
    with_(
        TXN,
        f"SELECT src_row, CASE bank_category WHEN 'PROMO' THEN 'CHF' WHEN 'SMALL' THEN '{BASE}' WHEN 'LARGE' THEN '{BASE}' WHEN 'MEDIUM' THEN NULL ELSE currency END AS resolved FROM txn",
    ),
)
def i10(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("bank_category")
    mode = F.when(b == "PROMO", "code").when(b == "SMALL", "use_base").otherwise("auto")
    column = F.when(b == "LARGE", "").when(b == "MEDIUM", "??").otherwise(F.col("currency"))
    return txn(spark, sf).select("src_row", cur.resolve_currency(mode, F.lit("CHF"), column, F.lit(BASE)).alias("resolved"))


@query(
    "I11_format_amount",
    with_(
        TXN + ", " + _CUR,
        """SELECT src_row, format('{:,.2f}', amount) || ' ' || en AS text_en, translate(format('{:,.2f}', amount), ',.', chr(160) || ',') || ' ' || uk AS text_uk
FROM txn JOIN cur ON cur.code = txn.currency""",
    ),
)
def i11(spark: SparkSession, sf: str) -> DataFrame:
    dim = cur.currency_frame(spark).select(F.col("code").alias("currency"), "fraction_digits", "symbol_en", "symbol_uk")
    rows = txn(spark, sf).join(dim, "currency")
    text = lambda lang: cur.format_amount(F.col("amount"), F.col("fraction_digits"), F.col(f"symbol_{lang}"), lang)
    return rows.select("src_row", text("en").alias("text_en"), text("uk").alias("text_uk"))


@query(
    "I12_locale_currency",
    "SELECT lang, CASE lang WHEN 'en' THEN 'USD' ELSE 'EUR' END AS currency, count(*) AS n FROM documents GROUP BY lang",
)
def i12(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    locale = F.when(lang == "en", "en-US").otherwise(F.concat(lang, F.lit("-"), F.upper(lang)))
    return read_table(spark, sf, "documents").groupBy("lang", cur.locale_to_currency(locale).alias("currency")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "I13_display_label",
    with_(RAW, "SELECT src_row, coalesce(c_details, c_note, c_mcc, '—') AS label FROM cells"),
)
def i13(spark: SparkSession, sf: str) -> DataFrame:
    rows = _remapped(spark, sf, {4: m.CATEGORY}, also=(3, 5))
    label = tx.display_label(cell(3, "text"), F.lit("  "), cell(4, "text"), cell(5, "text"))
    return rows.select("src_row", label.alias("label"))


@query(
    "D14_mcc_titles",
    with_(
        TXN,
        """, titles AS (SELECT lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc, min(p_name) AS title FROM part WHERE p_size <= 40 GROUP BY p_size)
SELECT src_row, coalesce(t.title, x.mcc, '—') AS mcc_title FROM (SELECT src_row, CASE WHEN bank_category <> 'LARGE' THEN mcc END AS mcc FROM txn) x LEFT JOIN titles t ON t.mcc = x.mcc""",
    ),
)
def d14(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part").where("p_size <= 40")
    titles = p.groupBy(F.lpad((F.col("p_size") + 5000).cast("string"), 4, "0").alias("mcc")).agg(F.min("p_name").alias("title"))
    rows = txn(spark, sf).withColumn("mcc", F.when(F.col("bank_category") != "LARGE", F.col("mcc")))
    return rows.join(titles, "mcc", "left").select("src_row", F.coalesce("title", "mcc", F.lit(tx.EM_DASH)).alias("mcc_title"))


def segment_currencies(spark: SparkSession, sf: str) -> DataFrame:
    """A currency-shaped dimension from customers: one code per customer, the
    nation as exact symbol and the market segment as special symbol."""
    c = read_table(spark, sf, "customer")
    return c.select(
        F.col("c_name").alias("code"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("symbol_en"),
        F.col("c_name").alias("symbol_uk"),
        F.array("c_mktsegment", F.concat(F.lit("N"), ((F.col("c_nationkey") + 1) % 30).cast("string"))).alias("special"),
        F.col("c_custkey").alias("pos"),
    )


_CLAIMS = """
claims AS (
  SELECT 'N' || c_nationkey AS symbol, c_name AS code, 1 AS pass, c_custkey AS pos FROM customer
  UNION ALL SELECT c_name, c_name, 1, c_custkey FROM customer
  UNION ALL SELECT c_mktsegment, c_name, 2, c_custkey FROM customer
  UNION ALL SELECT 'N' || (c_nationkey + 1) % 30, c_name, 2, c_custkey FROM customer)
"""


@query("E20_ambiguous_symbols", with_(_CLAIMS, "SELECT symbol, count(DISTINCT code) AS codes FROM claims GROUP BY symbol HAVING count(DISTINCT code) > 1"))
def e20(spark: SparkSession, sf: str) -> DataFrame:
    return cur.ambiguous_symbols(segment_currencies(spark, sf))


@query("G5_symbol_owner", with_(_CLAIMS, "SELECT symbol, arg_min(code, struct_pack(a := pass, b := pos)) AS code FROM claims GROUP BY symbol"))
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return cur.symbol_owner(segment_currencies(spark, sf))
