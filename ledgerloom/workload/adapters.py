"""Statement-shaped views over the given tables, in Spark and in SQL.

Every adapter exists twice: a DataFrame for the library and a CTE for the
check in DuckDB. Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.identity import base_hash, field_texts, with_final_hash
from ledgerloom.functions.indexing import block_of, dense_index
from ledgerloom.operators.conditions import Condition, Rule
from ledgerloom.session import materialize
from ledgerloom.sources.tables import read_table, read_with_position

BASE = "EUR"
QUOTED = (("UAH", 41.0), ("EUR", 0.92), ("GBP", 0.79))

CATEGORIES = (
    ("food", "Food", "base", False),
    ("fuel", "Fuel", "base", False),
    ("home", "Home", "UAH", False),
    ("travel", "Travel", "EUR", False),
    ("fees", "Fees", "base", False),
    ("bonus", "Bonus", "USD", False),
    ("gifts", "Gifts", "base", True),
    ("other", "Other", "base", False),
)

RULES = (
    Rule(1, 0, "fees", (Condition("is_bank_commission", "isTrue"),)),
    Rule(2, 1, "bonus", (Condition("is_cashback", "isTrue"),)),
    Rule(3, 2, "home", (Condition("description", "contains", "anvil"), Condition("mcc", "oneOf", values=("5005", "5006", "5007", "5010", "5011")))),
    Rule(4, 3, "travel", (Condition("amount", "greaterThan", 90000, currency="EUR"),)),
    Rule(5, 4, "food", (Condition("bank_category", "equals", "ECONOMY"), Condition("description", "startsWith", "red"))),
    Rule(6, 5, "fuel", (Condition("date", "firstMondayOfMonth"),)),
    Rule(7, 6, "home", (Condition("counterparty", "matches", "#0+[1-3]$"), Condition("currency", "notEquals", "USD"))),
    Rule(8, 7, "gifts", (Condition("date", "dayRange", lo=24, hi=26), Condition("bank_category", "oneOf", values=("PROMO", "SMALL")))),
    Rule(9, 8, "travel", (Condition("amount", "between", lo=20000, hi=30000, currency="GBP"),)),
    Rule(10, 9, "food", (Condition("description", "endsWith", "plate"), Condition("account", "notEquals", "ACC7"))),
    Rule(11, 10, "fuel", (Condition("mcc", "equals", "5050"),)),
    Rule(12, 11, "home", (Condition("description", "notContains", "g"), Condition("date", "lastSundayOfMonth"))),
)

# The proposed rule set of the preview queries: two rules swapped, one edited,
# one dropped and one added.
PROPOSED = tuple(
    r
    for r in (
        *[
            {
                5: Rule(5, 5, "food", RULES[4].conditions),
                6: Rule(6, 4, "fuel", RULES[5].conditions),
                9: Rule(9, 8, "travel", (Condition("amount", "between", lo=20000, hi=40000, currency="GBP"),)),
                11: None,
            }.get(r.rule_id, r)
            for r in RULES
        ],
        Rule(13, 12, "other", (Condition("currency", "equals", "UAH"), Condition("bank_category", "equals", "LARGE"))),
    )
    if r is not None
)

# The same two rule sets as SQL (first match wins).
_CASES = {
    1: "is_bank_commission",
    2: "is_cashback",
    3: "description LIKE '%anvil%' AND mcc IN ('5005','5006','5007','5010','5011')",
    4: "currency = 'EUR' AND amount > 90000",
    5: "bank_category = 'ECONOMY' AND description LIKE 'red%'",
    6: "isodow(date) = 1 AND day(date) <= 7",
    7: "regexp_matches(counterparty, '#0+[1-3]$') AND currency <> 'USD'",
    8: "day(date) BETWEEN 24 AND 26 AND bank_category IN ('PROMO','SMALL')",
    9: "currency = 'GBP' AND amount BETWEEN 20000 AND 30000",
    10: "description LIKE '%plate' AND account <> 'ACC7'",
    11: "mcc = '5050'",
    12: "description NOT LIKE '%g%' AND isodow(date) = 7 AND day(date) > day(last_day(date)) - 7",
}
CATEGORY_OF = {r.rule_id: r.category_id for r in (*RULES, *PROPOSED)}
RULE_SQL = "CASE " + " ".join(f"WHEN {_CASES[r.rule_id]} THEN {r.rule_id}" for r in RULES) + " END"
_PROPOSED_CASES = {
    **_CASES,
    9: "currency = 'GBP' AND amount BETWEEN 20000 AND 40000",
    13: "currency = 'UAH' AND bank_category = 'LARGE'",
}
PROPOSED_SQL = (
    "CASE "
    + " ".join(
        f"WHEN {_PROPOSED_CASES[r.rule_id]} THEN '{r.category_id}'" for r in sorted(PROPOSED, key=lambda r: r.order)
    )
    + " END"
)
CATEGORY_SQL = "CASE rule_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CATEGORY_OF.items()) + " END"


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES), "id string, name string, currency string, is_archived boolean")


# ------------------------------------------------------------ transactions

_TXN_COLUMNS = (
    "file_id", "src_row", "row_block", "date", "amount", "currency", "description", "counterparty",
    "account", "bank_category", "mcc", "commission", "cashback", "status", "is_bank_commission", "is_cashback",
)


def txn(spark: SparkSession, folder: str, *also: str) -> DataFrame:
    """Source rows of the statements: one file per supplier; ``also`` names further columns of the line."""
    # What the joins move is made small before them: days, and a remainder instead of a key.
    li = read_with_position(spark, folder, "lineitem").withColumns(
        {"_day": F.col("l_shipdate").cast("date"), "_account": (F.col("l_orderkey") % 50).cast("int")}
    )
    part = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_size")
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    codes = F.array(*[F.lit(c) for c in ("UAH", "USD", "EUR", "GBP")])
    # The part's texts are long, so they come last.
    rows = li.join(supplier, li.l_suppkey == supplier.s_suppkey).join(part, li.l_partkey == part.p_partkey)
    return rows.select(
        F.col("l_suppkey").alias("file_id"),
        "src_row",
        block_of(F.col("src_row")).alias("row_block"),
        F.col("_day").alias("date"),
        F.col("l_extendedprice").alias("amount"),
        F.get(codes, F.col("s_nationkey") % 4).alias("currency"),
        F.col("p_name").alias("description"),
        F.col("s_name").alias("counterparty"),
        F.concat(F.lit("ACC"), F.col("_account").cast("string")).alias("account"),
        F.col("p_type").alias("bank_category"),
        F.lpad((F.col("p_size") + 5000).cast("string"), 4, "0").alias("mcc"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("cashback"),
        F.when(F.col("l_quantity") <= 43, "OK").otherwise("FAILED").alias("status"),
        F.lit(False).alias("is_bank_commission"),
        F.lit(False).alias("is_cashback"),
        *also,
    )


TXN = """
li AS (SELECT *, row_number() OVER () - 1 AS src_row FROM lineitem),
txn AS (
  SELECT l_suppkey AS file_id, src_row, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS amount,
         (['UAH','USD','EUR','GBP'])[s_nationkey % 4 + 1] AS currency, p_name AS description,
         s_name AS counterparty, 'ACC' || (l_orderkey % 50) AS account, p_type AS bank_category,
         lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc,
         l_extendedprice * l_tax AS commission, l_extendedprice * l_discount AS cashback,
         CASE WHEN l_quantity <= 43 THEN 'OK' ELSE 'FAILED' END AS status,
         FALSE AS is_bank_commission, FALSE AS is_cashback
  FROM li JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""


def indexed_txn(spark: SparkSession, folder: str) -> DataFrame:
    return dense_index(txn(spark, folder), ["file_id"], "row_block", ["src_row"])


INDEXED = TXN + """,
itxn AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY src_row) - 1 AS row_index FROM txn)
"""


# -------------------------------------------------------------------- hash


#: Columns of a statement that neither its identity nor a rule looks at.
_BESIDE = ("commission", "cashback", "status")
#: What the earlier import marks its lines by.
MARKS = ("l_returnflag", "l_quantity", "l_linenumber")


def hashed_txn(spark: SparkSession, folder: str, *also: str, whole: bool = False) -> DataFrame:
    """Transactions with base and final hash; the batch is the file.

    The rows are read several times, to count copies and to number them, so they
    are stored without their hashes, which are worked out again where they are
    read. Only with ``whole`` they keep the columns that no hash and no rule needs.
    """
    rows = txn(spark, folder, *also)
    rows = materialize(rows if whole else rows.drop(*_BESIDE), "txn", compression="zstd")
    rows = rows.withColumn("base_hash", base_hash(field_texts(rows), F.lit("main")))
    return with_final_hash(rows, "file_id", ["src_row"], "row_block")


def _net(name: str, expr: str) -> str:
    return f"'{name}=' || coalesce(length({expr}) || ':' || {expr}, '~') || ';'"


_HASH_TEXT = " || ".join(
    [
        _net("date", "CAST(date AS VARCHAR)"),
        _net("amount", "CAST(CAST(amount AS DECIMAL(38,10)) AS VARCHAR)"),
        _net("description", "description"),
        _net("counterparty", "counterparty"),
        _net("currency", "currency"),
        "'balance=~;'",
        _net("account", "account"),
        _net("mcc", "mcc"),
        "'exchange_rate=~;'",
        "'kind=main'",
    ]
)
HASHED = TXN + f""",
based AS (SELECT *, sha256({_HASH_TEXT}) AS base_hash FROM txn),
htxn AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, base_hash ORDER BY src_row) - 1 AS dup,
         sha256(base_hash || '#' || (row_number() OVER (PARTITION BY file_id, base_hash ORDER BY src_row) - 1)) AS hash,
         year(date) AS year, month(date) AS month
  FROM based)
"""


# ------------------------------------------------------------------- rates


def wide_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate tables as they are delivered: one map of texts per base and date.

    USD tables exist on all days but Sunday, and quote GBP as zero on the first
    of a month. On Sundays only a GBP table (for EUR) and an EUR table (for
    UAH) exist.
    """
    days = read_table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    swing = 1.0 + F.dayofmonth("date") / 1000.0
    quote = lambda v: (F.lit(v) * swing).cast("string")
    sunday = F.dayofweek("date") == 1
    usd = F.create_map(
        F.lit("UAH"), quote(41.0),
        F.lit("EUR"), quote(0.92),
        F.lit("GBP"), F.when(F.dayofmonth("date") == 1, F.lit("0")).otherwise(quote(0.79)),
    )
    gbp = F.create_map(F.lit("EUR"), quote(1.17))
    eur = F.create_map(F.lit("UAH"), quote(44.0))
    tables = F.when(
        sunday,
        F.array(
            F.struct(F.lit("GBP").alias("base"), gbp.alias("quotes")),
            F.struct(F.lit("EUR").alias("base"), eur.alias("quotes")),
        ),
    ).otherwise(F.array(F.struct(F.lit("USD").alias("base"), usd.alias("quotes"))))
    return days.select("date", F.explode(tables).alias("t")).select("t.base", "date", "t.quotes")


RATES = """
days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
swing AS (SELECT date, 1.0::DOUBLE + day(date) / 1000.0::DOUBLE AS f, dayofweek(date) = 0 AS sunday FROM days),
rates AS (
  SELECT 'USD' AS base, date, 'UAH' AS ccy, 41.0::DOUBLE * f AS rate FROM swing WHERE NOT sunday
  UNION ALL SELECT 'USD', date, 'EUR', 0.92::DOUBLE * f FROM swing WHERE NOT sunday
  UNION ALL SELECT 'USD', date, 'GBP', CASE WHEN day(date) = 1 THEN 0 ELSE 0.79::DOUBLE * f END FROM swing WHERE NOT sunday
  UNION ALL SELECT 'GBP', date, 'EUR', 1.17::DOUBLE * f FROM swing WHERE sunday
  UNION ALL SELECT 'EUR', date, 'UAH', 44.0::DOUBLE * f FROM swing WHERE sunday)
"""
