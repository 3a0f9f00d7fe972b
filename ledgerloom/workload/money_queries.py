"""Queries on rates, conversion, the footprint store and typicality."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.functions.dates import month_key
from ledgerloom.operators import categorize as cat
from ledgerloom.operators import convert
from ledgerloom.operators import typicality as ty
from ledgerloom.session import materialize, shared_dir
from ledgerloom.sources import rates as rt
from ledgerloom.sources import store
from ledgerloom.sources.tables import read_table
from ledgerloom.workload.adapters import (
    BASE,
    HASHED,
    INDEXED,
    MARKS,
    RATES,
    RULE_SQL,
    RULES,
    TXN,
    hashed_txn,
    indexed_txn,
    txn,
    wide_rates,
)
from ledgerloom.workload.rule_queries import PART_RULES, branded_txn, part_rules
from ledgerloom.workload.registry import query, with_
from ledgerloom.workload.rule_queries import LADDER, STORED, laddered, stored_footprints

# --------------------------------------------------------------------- rates


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """The rates, stored: a set bounded by the calendar, which rows meet without being moved."""
    return materialize(rt.long_rates(wide_rates(spark, sf)), "rates")


@query("A14_rate_table", with_(RATES, "SELECT base, date, ccy, rate FROM rates"))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    return rates(spark, sf).select("base", "date", "ccy", "rate")


@query(
    "A15_rates_for_dates",
    with_(
        RATES,
        "SELECT base, date, ccy, rate FROM rates WHERE base = 'USD' AND date IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F')",
    ),
)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    wanted = read_table(spark, sf, "orders").where("o_orderstatus = 'F'")
    days = wanted.select(F.col("o_orderdate").cast("date").alias("date"))
    return rt.rates_for_dates(rates(spark, sf), days, "USD").select("base", "date", "ccy", "rate")


@query(
    "A16_rate_upsert",
    with_(
        RATES,
        """, fetched AS (SELECT base, date, ccy, rate * 2 AS rate FROM rates WHERE day(date) > 20
 UNION ALL SELECT DISTINCT 'USD', CAST(o_orderdate AS DATE), 'PLN', 4.0::DOUBLE FROM orders)
SELECT base, date, ccy, coalesce(f.rate, r.rate) AS rate FROM rates r FULL JOIN fetched f USING (base, date, ccy)""",
    ),
)
def a16(spark: SparkSession, sf: str) -> DataFrame:
    """Merge into a written store and read it back."""
    stored = rates(spark, sf)
    fetched = stored.where(F.dayofmonth("date") > 20).withColumn("rate", F.col("rate") * 2)
    days = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    zloty = days.select(F.lit("USD").alias("base"), "date", F.lit("PLN").alias("ccy"), F.lit(4.0).alias("rate"))
    path = shared_dir(spark, "rates")
    rt.write_rates(rt.merge_rates(stored, fetched.unionByName(zloty)), path)
    return spark.read.parquet(path).select("base", "date", "ccy", "rate")


_REQUESTED = "req AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"


@query(
    "A17_backfill_plan",
    with_(
        RATES + ", " + _REQUESTED,
        "SELECT date FROM req WHERE date NOT IN (SELECT date FROM rates WHERE base = 'USD') ORDER BY date LIMIT 60",
    ),
)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    requested = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return rt.backfill_plan(requested, rates(spark, sf), "USD", cap=100, used=40)


@query(
    "A17_backfill_summary",
    with_(
        RATES + ", " + _REQUESTED,
        """, m AS (SELECT count(*) AS requested, count(*) FILTER (WHERE date IN (SELECT date FROM rates WHERE base = 'USD')) AS cached FROM req)
SELECT requested, cached, least(requested - cached, 60) AS allowed, requested - cached - least(requested - cached, 60) AS cap_cut FROM m""",
    ),
)
def a17_summary(spark: SparkSession, sf: str) -> DataFrame:
    requested = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return rt.backfill_summary(requested, rates(spark, sf), "USD", cap=100, used=40)


@query(
    "H7_first_missing_dates",
    with_(
        RATES + ", " + _REQUESTED,
        "SELECT date FROM req WHERE date NOT IN (SELECT date FROM rates WHERE base = 'USD') ORDER BY date LIMIT 10",
    ),
)
def h7(spark: SparkSession, sf: str) -> DataFrame:
    requested = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return rt.backfill_plan(requested, rates(spark, sf), "USD", cap=10, used=0)


@query(
    "J3_distinct_dates",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
)
def j3(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


@query(
    "J4_requested_minus_cached",
    with_(RATES + ", " + _REQUESTED, "SELECT date FROM req EXCEPT SELECT date FROM rates WHERE base = 'USD'"),
)
def j4(spark: SparkSession, sf: str) -> DataFrame:
    requested = read_table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return requested.distinct().join(rates(spark, sf).where("base = 'USD'").select("date"), "date", "left_anti")


@query(
    "E21_monthly_usage",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month_key, count(*) AS used FROM orders GROUP BY 1",
)
def e21_usage(spark: SparkSession, sf: str) -> DataFrame:
    return rt.monthly_usage(read_table(spark, sf, "orders"), "o_orderdate")


# ---------------------------------------------------------------- conversion

_USD = """, usd AS (
  SELECT t.*, CASE WHEN currency = 'USD' THEN amount WHEN r.rate <> 0 THEN amount / r.rate END AS amount_usd
  FROM txn t LEFT JOIN rates r ON r.base = 'USD' AND r.date = t.date AND r.ccy = t.currency)
"""
_CHAIN = f"""
CASE WHEN currency = '{BASE}' THEN amount
     WHEN currency = 'USD' AND ut.rate <> 0 THEN amount * ut.rate
     WHEN uf.rate <> 0 AND ut.rate <> 0 THEN amount / uf.rate * ut.rate
     WHEN di.rate <> 0 THEN amount * di.rate
     WHEN inv.rate <> 0 THEN amount / inv.rate END"""


def _converted_sql(source: str) -> str:
    return f"""
  SELECT t.*, {_CHAIN} AS converted FROM {source} t
  LEFT JOIN rates uf ON uf.base = 'USD' AND uf.date = t.date AND uf.ccy = t.currency
  LEFT JOIN rates ut ON ut.base = 'USD' AND ut.date = t.date AND ut.ccy = '{BASE}'
  LEFT JOIN rates di ON di.base = t.currency AND di.date = t.date AND di.ccy = '{BASE}'
  LEFT JOIN rates inv ON inv.base = '{BASE}' AND inv.date = t.date AND inv.ccy = t.currency"""


@query(
    "D5_amount_in_usd",
    with_(TXN + "," + RATES + _USD, "SELECT src_row, round(amount_usd, 6) AS amount_usd, amount_usd IS NULL AS rate_missing FROM usd"),
)
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return convert.with_usd(txn(spark, sf), rates(spark, sf)).select(
        "src_row", F.round("amount_usd", 6).alias("amount_usd"), "rate_missing"
    )


@query(
    "D6_conversion_chain",
    with_(TXN + "," + RATES, f"SELECT src_row, round(converted, 8) AS converted FROM ({_converted_sql('txn')})"),
)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return convert.with_converted(txn(spark, sf), rates(spark, sf), BASE).select(
        "src_row", F.round("converted", 8).alias("converted")
    )


_LEFT = LADDER + "," + RATES + ", lft AS (SELECT * FROM ladder WHERE resolved IS NULL), conv AS (" + _converted_sql("lft") + ")"


@query(
    "E11_remainder_magnitude",
    with_(
        _LEFT,
        "SELECT file_id, count(*) AS op_count, round(coalesce(sum(converted), 0), 2) AS base_total, count(*) FILTER (WHERE converted IS NULL) > 0 AS approx FROM conv GROUP BY file_id",
    ),
)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    out = convert.remainder_magnitude(laddered(spark, sf), rates(spark, sf), BASE)
    return out.withColumn("base_total", F.round("base_total", 2))


@query(
    "E11_remainder_without_rates",
    with_(
        LADDER,
        f"SELECT file_id, count(*) AS op_count, round(coalesce(sum(amount) FILTER (WHERE currency = '{BASE}'), 0), 2) AS base_total, count(*) FILTER (WHERE currency <> '{BASE}') > 0 AS approx FROM ladder WHERE resolved IS NULL GROUP BY file_id",
    ),
)
def e11_none(spark: SparkSession, sf: str) -> DataFrame:
    out = convert.remainder_magnitude(laddered(spark, sf), None, BASE)
    return out.withColumn("base_total", F.round("base_total", 2))


@query(
    "E11_pending_amounts",
    with_(_LEFT, "SELECT file_id, currency, round(sum(amount), 2) AS pending_amount FROM conv WHERE converted IS NULL GROUP BY file_id, currency"),
)
def e11_pending(spark: SparkSession, sf: str) -> DataFrame:
    out = convert.pending_amounts(laddered(spark, sf), rates(spark, sf), BASE)
    return out.withColumn("pending_amount", F.round("pending_amount", 2))


# --------------------------------------------------------------------- store


@query(
    "B29_footprints",
    with_(
        LADDER + "," + RATES,
        """, usd AS (SELECT t.*, CASE WHEN currency = 'USD' THEN amount WHEN r.rate <> 0 THEN amount / r.rate END AS amount_usd
  FROM ladder t LEFT JOIN rates r ON r.base = 'USD' AND r.date = t.date AND r.ccy = t.currency)
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, round(amount_usd, 6) AS amount_usd, resolved AS category_id, hash,
 CASE WHEN override_category IS NOT NULL THEN 1 ELSE 0 END AS is_manual FROM usd WHERE amount_usd IS NOT NULL""",
    ),
)
def b29(spark: SparkSession, sf: str) -> DataFrame:
    priced = convert.with_usd(laddered(spark, sf), rates(spark, sf)).where("not rate_missing")
    return store.footprint_of(priced).withColumn("amount_usd", F.round("amount_usd", 6))


def _written_store(spark: SparkSession, sf: str, marked: DataFrame | None = None) -> str:
    """A store that holds the earlier import."""
    path = shared_dir(spark, "store")
    store.put_batch(spark, path, stored_footprints(spark, sf, marked))
    return path


def saved_footprints(spark: SparkSession, sf: str, marked: DataFrame | None = None) -> DataFrame:
    """The earlier import, read back from the store."""
    return store.read_store(spark, _written_store(spark, sf, marked))


@query(
    "A18_footprint_upsert",
    with_(
        STORED + "," + RATES,
        """, valued AS (
  SELECT t.year, t.month, t.hash, CASE WHEN currency = 'USD' THEN amount WHEN r.rate <> 0 THEN amount / r.rate END AS amount_usd
  FROM htxn t LEFT JOIN rates r ON r.base = 'USD' AND r.date = t.date AND r.ccy = t.currency),
merged AS (
  SELECT year, month, hash, amount_usd, 'new' AS category_id FROM valued WHERE amount_usd IS NOT NULL
  UNION ALL SELECT year, month, hash, amount_usd, category_id FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM valued h WHERE h.amount_usd IS NOT NULL AND h.hash = s.hash AND h.year = s.year AND h.month = s.month))
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, coalesce(category_id, '-') AS category_id, count(*) AS records, count(DISTINCT hash) AS hashes, round(sum(amount_usd), 2) AS total
FROM merged GROUP BY ALL""",
    ),
)
def a18(spark: SparkSession, sf: str) -> DataFrame:
    """Commit all rows over an earlier import.

    The whole batch is refused, since some days have no rate, and leaves nothing
    behind; the rows with a rate are committed twice, and the second time
    changes nothing.
    """
    marked = hashed_txn(spark, sf, *MARKS)
    path = _written_store(spark, sf, marked)
    batch = marked.drop(*MARKS).withColumn("category_id", F.lit("new")).withColumn("is_manual", F.lit(0))
    priced = materialize(convert.with_usd(batch, rates(spark, sf)).select(*store.PRICED), "priced", compression="zstd")
    with contextlib.suppress(store.RatesMissing):
        store.commit(spark, path, priced)
    valued = priced.where("not rate_missing")
    store.commit(spark, path, valued)
    store.commit(spark, path, valued)
    return (
        store.read_store(spark, path)
        .groupBy("year", "month", F.coalesce("category_id", F.lit("-")).alias("category_id"))
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_distinct("hash").alias("hashes"),
            F.round(F.sum("amount_usd"), 2).alias("total"),
        )
    )


_WANTED_PERIODS = "SELECT DISTINCT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders WHERE o_orderpriority = '1-URGENT'"


@query(
    "A19_period_scan",
    with_(
        STORED,
        f"SELECT CAST(s.year AS INTEGER) AS year, CAST(s.month AS INTEGER) AS month, count(*) AS records, count(*) FILTER (WHERE is_manual = 1) AS manual FROM stored s JOIN ({_WANTED_PERIODS}) w ON s.year = w.year AND s.month = w.month GROUP BY ALL",
    ),
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    path = _written_store(spark, sf)
    urgent = read_table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    wanted = urgent.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    saved = store.read_store(spark, path)
    every = store.of_periods(saved, wanted).groupBy("year", "month").agg(F.count(F.lit(1)).alias("records"))
    manual = store.of_periods(saved, wanted, manual_only=True).groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("manual")
    )
    return every.join(manual, ["year", "month"], "left").withColumn("manual", F.coalesce("manual", F.lit(0)))


@query(
    "A20_index_lookup",
    with_(STORED, "SELECT hash, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month FROM stored WHERE category_id = 'gifts' AND is_manual = 1"),
)
def a20(spark: SparkSession, sf: str) -> DataFrame:
    found = store.find_by(saved_footprints(spark, sf), "category_id", "gifts", F.col("is_manual") == 1)
    return found.select("hash", "year", "month")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def _buyers(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("balance"))
    known = o.select(F.col("o_custkey").alias("id"), F.lit("buyer").alias("name"), "balance")
    return known.unionByName(known.select((F.col("id") + 1_000_000_000).alias("id"), "name", "balance"))


_KEYED = """
tab AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer),
buy0 AS (SELECT o_custkey AS id, 'buyer' AS name, max(o_totalprice) AS balance FROM orders GROUP BY o_custkey),
buy AS (SELECT * FROM buy0 UNION ALL SELECT id + 1000000000, name, balance FROM buy0)
"""


@query("A21_create", with_(_KEYED, "SELECT * FROM tab UNION ALL SELECT * FROM buy WHERE id NOT IN (SELECT id FROM tab)"))
def a21_create(spark: SparkSession, sf: str) -> DataFrame:
    table = _customers(spark, sf)
    fresh = _buyers(spark, sf).join(table, "id", "left_anti")
    return store.create_rows(table, fresh, ["id"])


@query("A21_create_clashes", with_(_KEYED, "SELECT id FROM buy WHERE id IN (SELECT id FROM tab)"))
def a21_clash(spark: SparkSession, sf: str) -> DataFrame:
    return store.duplicate_keys(_customers(spark, sf), _buyers(spark, sf), ["id"])


@query("A21_read", with_(_KEYED, "SELECT * FROM tab WHERE id IN (SELECT id FROM buy)"))
def a21_read(spark: SparkSession, sf: str) -> DataFrame:
    return store.read_rows(_customers(spark, sf), _buyers(spark, sf).select("id"))


@query("A21_update", with_(_KEYED, "SELECT id, coalesce(b.name, t.name) AS name, coalesce(b.balance, t.balance) AS balance FROM tab t LEFT JOIN buy b USING (id)"))
def a21_update(spark: SparkSession, sf: str) -> DataFrame:
    return store.update_rows(_customers(spark, sf), _buyers(spark, sf), ["id"])


@query("A21_upsert", with_(_KEYED, "SELECT * FROM buy UNION ALL SELECT * FROM tab WHERE id NOT IN (SELECT id FROM buy)"))
def a21_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return store.upsert_rows(_customers(spark, sf), _buyers(spark, sf), ["id"])


@query("A21_delete", with_(_KEYED, "SELECT * FROM tab WHERE id NOT IN (SELECT id FROM buy)"))
def a21_delete(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_rows(_customers(spark, sf), _buyers(spark, sf).select("id"))


@query("A21_delete_count", with_(_KEYED, "SELECT count(*) AS deleted FROM tab WHERE id IN (SELECT id FROM buy)"))
def a21_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return store.deleted_count(_customers(spark, sf), _buyers(spark, sf).select("id"))


@query("A21_find", with_(_KEYED, "SELECT * FROM tab WHERE balance > 5000"))
def a21_find(spark: SparkSession, sf: str) -> DataFrame:
    return _customers(spark, sf).where(F.col("balance") > 5000)


@query("A21_keys", with_(_KEYED, "SELECT id FROM tab"))
def a21_keys(spark: SparkSession, sf: str) -> DataFrame:
    return store.all_keys(_customers(spark, sf), ["id"])


@query(
    "A22_schema_backfill",
    with_(STORED, "SELECT hash, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CASE WHEN category_id = 'gifts' THEN is_manual ELSE 0 END AS is_manual FROM stored"),
)
def a22(spark: SparkSession, sf: str) -> DataFrame:
    """Old files lack the flag; both layouts are read together."""
    path = shared_dir(spark, "layouts")
    rows = stored_footprints(spark, sf)
    gifts = F.coalesce(F.col("category_id") == "gifts", F.lit(False))
    rows.where(~gifts).drop("is_manual").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/layout=1")
    rows.where(gifts).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/layout=2")
    both = spark.read.option("mergeSchema", "true").parquet(path)
    return store.rebuild(both, {"is_manual": 0}).select("hash", "year", "month", "is_manual")


@query(
    "D7_duplicate_check",
    with_(STORED, "SELECT src_row, EXISTS (SELECT 1 FROM stored s WHERE s.hash = h.hash AND s.year = h.year AND s.month = h.month) AS dup FROM htxn h"),
)
def d7(spark: SparkSession, sf: str) -> DataFrame:
    marked = hashed_txn(spark, sf, *MARKS)
    rows = cat.with_period(marked.drop(*MARKS))
    known = store.of_periods(saved_footprints(spark, sf, marked), cat.periods(marked))
    return store.mark_duplicates(rows, known).select("src_row", "dup")


@query(
    "J6_new_and_duplicate",
    with_(
        STORED,
        """SELECT file_id, count(*) FILTER (WHERE s.hash IS NOT NULL) AS dup, count(*) FILTER (WHERE s.hash IS NULL) AS fresh
FROM htxn h LEFT JOIN stored s ON s.hash = h.hash AND s.year = h.year AND s.month = h.month GROUP BY file_id""",
    ),
)
def j6(spark: SparkSession, sf: str) -> DataFrame:
    marked = hashed_txn(spark, sf, *MARKS)
    rows = cat.with_period(marked.drop(*MARKS))
    known = store.of_periods(saved_footprints(spark, sf, marked), cat.periods(marked))
    return store.mark_duplicates(rows, known).groupBy("file_id").agg(
        F.count_if("dup").alias("dup"), F.count_if(~F.col("dup")).alias("fresh")
    )


@query(
    "J2_keyed_union",
    with_(
        STORED,
        """SELECT count(*) AS records, count(DISTINCT hash) AS hashes FROM (
 SELECT hash, year, month FROM stored UNION SELECT hash, year, month FROM htxn WHERE bank_category = 'PROMO')""",
    ),
)
def j2(spark: SparkSession, sf: str) -> DataFrame:
    marked = hashed_txn(spark, sf, *MARKS)
    promo = cat.with_period(marked.drop(*MARKS)).where("bank_category = 'PROMO'")
    new = store.footprint_of(
        promo.withColumn("amount_usd", F.col("amount")).withColumn("category_id", F.lit("x")).withColumn("is_manual", F.lit(0))
    )
    merged = store.merge_footprints(stored_footprints(spark, sf, marked), new)
    return merged.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("hash").alias("hashes"))


@query("D16_batch_periods", with_(TXN, "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month FROM txn"))
def d16(spark: SparkSession, sf: str) -> DataFrame:
    return cat.periods(txn(spark, sf))


@query("I16_period_keys", with_(HASHED, "SELECT src_row, hash || '|' || year || '|' || month AS override_key, strftime(date, '%Y-%m') AS month_key FROM htxn"))
def i16(spark: SparkSession, sf: str) -> DataFrame:
    rows = cat.with_period(hashed_txn(spark, sf))
    key = F.concat_ws("|", "hash", F.col("year").cast("string"), F.col("month").cast("string"))
    return rows.select("src_row", key.alias("override_key"), month_key(F.col("date")).alias("month_key"))


@query("I6_row_hash", with_(HASHED, "SELECT src_row, base_hash FROM htxn"))
def i6(spark: SparkSession, sf: str) -> DataFrame:
    return hashed_txn(spark, sf).select("src_row", "base_hash")


@query("G1_duplicate_counter", with_(HASHED, "SELECT file_id, base_hash, dup, hash FROM htxn"))
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return hashed_txn(spark, sf).select("file_id", "base_hash", "dup", "hash")


@query("G8_dense_row_index", with_(INDEXED, "SELECT file_id, src_row, row_index FROM itxn"))
def g8(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_txn(spark, sf).select("file_id", "src_row", "row_index")


# ----------------------------------------------------------------- typicality


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    rows = txn(spark, sf).withColumn("row_index", F.col("src_row"))
    return ty.by_winning_rule(rows, RULES).select(
        "bucket", "row_index", "src_row", "mcc", "counterparty", "currency", "bank_category", "amount", "description"
    )


def stored_facts(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(ty.facts(bucketed(spark, sf)), "facts")


BUCKETED = TXN + f""",
b AS (SELECT * FROM (SELECT *, CAST({RULE_SQL} AS BIGINT) AS bucket, src_row AS row_index FROM txn) WHERE bucket IS NOT NULL),
sizes AS (SELECT bucket, count(*) AS bucket_size FROM b GROUP BY bucket),
cc AS (
  SELECT bucket, field, value, count(*) AS n, min(row_index) AS first_row FROM (
    SELECT bucket, row_index, 'mcc' AS field, mcc AS value FROM b
    UNION ALL SELECT bucket, row_index, 'counterparty', counterparty FROM b
    UNION ALL SELECT bucket, row_index, 'currency', currency FROM b
    UNION ALL SELECT bucket, row_index, 'bank_category', bank_category FROM b)
  GROUP BY bucket, field, value),
cp AS (
  SELECT bucket, field, CAST(sum(n) AS BIGINT) AS present, arg_max(value, struct_pack(n := n, e := -first_row)) AS mode,
         max(n) / sum(n)::DOUBLE AS p_mode, sum(n) / max(bucket_size)::DOUBLE AS coverage
  FROM cc JOIN sizes USING (bucket) GROUP BY bucket, field),
am AS (
  SELECT b.bucket, b.currency, median(amount) AS raw_median, median(ln(abs(amount))) AS log_median, count(*) AS amount_n
  FROM b GROUP BY ALL),
ap AS (
  SELECT am.*, (SELECT median(abs(ln(abs(amount)) - am.log_median)) FROM b WHERE b.bucket = am.bucket AND b.currency = am.currency) AS log_mad
  FROM am),
tok AS (
  SELECT bucket, row_index, unnest(list_distinct(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'),
         lambda t: regexp_full_match(t, '[a-z]{{3,}}')))) AS token FROM b),
df AS (SELECT bucket, token, count(*) / any_value(bucket_size)::DOUBLE AS df FROM tok JOIN sizes USING (bucket) GROUP BY bucket, token),
inf AS (
  SELECT * FROM cp WHERE coverage >= 0.5 AND p_mode >= 0.5 AND NOT (
    (bucket = 3 AND field = 'mcc') OR (bucket = 4 AND field = 'currency') OR (bucket = 5 AND field = 'bank_category')
    OR (bucket = 7 AND field IN ('counterparty', 'currency')) OR (bucket = 8 AND field = 'bank_category')
    OR (bucket = 9 AND field = 'currency') OR (bucket = 11 AND field = 'mcc')))
"""
SCORED = BUCKETED + """,
sc AS (
  SELECT b.*, s.bucket_size,
    (SELECT 1 - (cc.n / i.present::DOUBLE) / i.p_mode FROM inf i JOIN cc USING (bucket, field) WHERE i.bucket = b.bucket AND i.field = 'mcc' AND cc.value = b.mcc) AS a_mcc,
    (SELECT 1 - (cc.n / i.present::DOUBLE) / i.p_mode FROM inf i JOIN cc USING (bucket, field) WHERE i.bucket = b.bucket AND i.field = 'counterparty' AND cc.value = b.counterparty) AS a_counterparty,
    (SELECT 1 - (cc.n / i.present::DOUBLE) / i.p_mode FROM inf i JOIN cc USING (bucket, field) WHERE i.bucket = b.bucket AND i.field = 'currency' AND cc.value = b.currency) AS a_currency,
    (SELECT 1 - (cc.n / i.present::DOUBLE) / i.p_mode FROM inf i JOIN cc USING (bucket, field) WHERE i.bucket = b.bucket AND i.field = 'bank_category' AND cc.value = b.bank_category) AS a_bank_category,
    (SELECT least(greatest((abs(ln(abs(b.amount)) - log_median) / (1.4826 * log_mad) - 3) / 3, 0), 1) FROM ap WHERE ap.bucket = b.bucket AND ap.currency = b.currency AND amount_n >= 5 AND log_mad >= 0.1) AS a_amount,
    CASE WHEN b.bucket IN (SELECT bucket FROM df WHERE df >= 0.5) THEN
      least(coalesce((SELECT 1 - min(df.df) FROM tok JOIN df USING (bucket, token) WHERE tok.bucket = b.bucket AND tok.row_index = b.row_index), 0), 0.5) END AS a_description
  FROM b JOIN sizes s ON s.bucket = b.bucket WHERE s.bucket_size >= 8),
scored AS (
  SELECT *, 1 - (1 - coalesce(a_mcc, 0)) * (1 - coalesce(a_counterparty, 0)) * (1 - coalesce(a_currency, 0))
   * (1 - coalesce(a_bank_category, 0)) * (1 - coalesce(a_amount, 0)) * (1 - coalesce(a_description, 0)) AS atypicality
  FROM sc)
"""


@query(
    "E13_categorical_profile",
    with_(BUCKETED, "SELECT bucket, field, present, mode, round(p_mode, 9) AS p_mode, round(coverage, 9) AS coverage FROM cp"),
)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    prof = ty.categorical_profile(ty.facts(bucketed(spark, sf)))
    return prof.withColumn("p_mode", F.round("p_mode", 9)).withColumn("coverage", F.round("coverage", 9))


@query(
    "E14_amount_profile",
    with_(
        BUCKETED,
        "SELECT bucket, currency, round(raw_median, 4) AS raw_median, round(log_median, 9) AS log_median, round(log_mad, 9) AS log_mad, amount_n FROM ap",
    ),
)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    p = ty.amount_profile(stored_facts(spark, sf))
    return p.select(
        "bucket",
        "currency",
        F.round("raw_median", 4).alias("raw_median"),
        F.round("log_median", 9).alias("log_median"),
        F.round("log_mad", 9).alias("log_mad"),
        "amount_n",
    )


@query("E15_token_frequency", with_(BUCKETED, "SELECT bucket, token, round(df, 9) AS df FROM df"))
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return ty.token_frequency(ty.facts(bucketed(spark, sf))).withColumn("df", F.round("df", 9))


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select(F.col("lang").alias("bucket"), F.col("text").alias("description"))


@query(
    "E15_document_tokens_by_language",
    """WITH tok AS (
  SELECT lang AS bucket, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'),
         lambda t: regexp_full_match(t, '[a-z]{3,}')))) AS token FROM documents),
 sizes AS (SELECT lang AS bucket, count(*) AS n FROM documents GROUP BY lang)
SELECT bucket, token, round(count(*) / any_value(n)::DOUBLE, 9) AS df FROM tok JOIN sizes USING (bucket) GROUP BY bucket, token""",
)
def e15_docs(spark: SparkSession, sf: str) -> DataFrame:
    return ty.token_frequency(ty.facts(document_rows(spark, sf))).withColumn("df", F.round("df", 9))


@query(
    "E16_informative_fields",
    with_(
        BUCKETED,
        """SELECT bucket, field AS what FROM inf
UNION ALL SELECT bucket, 'amount:' || currency FROM ap WHERE amount_n >= 5 AND log_mad >= 0.1
UNION ALL SELECT bucket, 'description' FROM df WHERE df >= 0.5 GROUP BY bucket""",
    ),
)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_facts(spark, sf)
    fields = ty.informative_categorical(ty.categorical_profile(found), ty.rule_fields(RULES)).select(
        "bucket", F.col("field").alias("what")
    )
    amounts = ty.informative_amounts(ty.amount_profile(found)).select(
        "bucket", F.concat(F.lit("amount:"), "currency").alias("what")
    )
    text = ty.core_tokens(ty.token_frequency(found)).select("bucket", F.lit("description").alias("what"))
    return fields.unionByName(amounts).unionByName(text)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(bucketed(spark, sf), "bucketed")
    return ty.score(rows, ty.fit(rows, ty.rule_fields(RULES)))


def _field_score(field: str):
    hit = F.try_element_at(F.filter("scores", lambda s: s["field"] == field), F.lit(1))
    return F.round(hit["a"], 9).alias(f"a_{field}")


_FIELDS = ("mcc", "counterparty", "currency", "bank_category", "amount", "description")


@query(
    "E17_field_atypicality",
    with_(SCORED, "SELECT src_row, " + ", ".join(f"round(a_{f}, 9) AS a_{f}" for f in _FIELDS) + " FROM scored"),
)
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("src_row", *[_field_score(f) for f in _FIELDS])


_REASONS = """array_to_string(list_filter([
  CASE WHEN a_mcc >= 0.5 THEN 'mcc=' || mcc END,
  CASE WHEN a_amount >= 0.5 THEN 'amount=' || CAST(CAST(floor(abs(amount) / abs(raw_median) + 0.5) AS BIGINT) AS VARCHAR) END,
  CASE WHEN a_description >= 0.5 THEN 'description' END,
  CASE WHEN a_counterparty >= 0.5 THEN 'counterparty=' || counterparty END,
  CASE WHEN a_currency >= 0.5 THEN 'currency=' || s.currency END,
  CASE WHEN a_bank_category >= 0.5 THEN 'bank_category=' || bank_category END], lambda x: x IS NOT NULL), ',')"""


def _reason_text() -> Column:
    one = lambda r: F.concat(r["field"], F.coalesce(F.concat(F.lit("="), r["value"]), F.lit("")))
    return F.array_join(F.transform("reasons", one), ",").alias("reasons")


@query(
    "E18_flagged_rows",
    with_(
        SCORED,
        f"SELECT src_row, s.bucket, round(atypicality, 9) AS atypicality, {_REASONS} AS reasons FROM scored s LEFT JOIN (SELECT bucket, currency, raw_median FROM ap) m ON m.bucket = s.bucket AND m.currency = s.currency WHERE atypicality >= 0.6",
    ),
)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    return ty.flagged(scored(spark, sf)).select(
        "src_row", "bucket", F.round("atypicality", 9).alias("atypicality"), _reason_text()
    )


def set_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows bucketed by the winning rule of their own rule set."""
    rows = branded_txn(spark, sf).withColumn("row_index", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ty.by_winning_rule_by_set(rows, part_rules(spark, sf)).select(
        "bucket", "row_index", "mcc", "counterparty", "currency", "bank_category", "amount", "description"
    )


_SET_SCORED = PART_RULES + """,
parts AS (SELECT p_partkey, p_brand, p_type, p_name, lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc FROM part),
won AS (
  SELECT p.p_partkey, any_value(p.p_name) AS description, any_value(p.p_type) AS bank_category, any_value(p.mcc) AS mcc,
         any_value(p.p_brand) || '/' || min_by(r.rule_id, r."order") AS bucket
  FROM parts p JOIN prules r ON p.p_brand = r.ruleset_id AND p.p_type = r.p_type
   AND CASE WHEN r.p_size <= 25 THEN p.mcc IN (r.mcc_value, '5001') ELSE starts_with(p.p_name, r.first_word) END
  GROUP BY p.p_partkey),
used AS (
  SELECT ruleset_id || '/' || rule_id AS ubucket, unnest(['bank_category', CASE WHEN p_size <= 25 THEN 'mcc' ELSE 'description' END]) AS ufield FROM prules),
b AS (
  SELECT w.*, 'UAH' AS currency, CAST(NULL AS VARCHAR) AS counterparty, l_extendedprice AS amount, l_orderkey * 10 + l_linenumber AS row_index
  FROM lineitem JOIN won w ON l_partkey = p_partkey),
sizes AS (SELECT bucket, count(*) AS bucket_size FROM b GROUP BY bucket),
cc AS (
  SELECT bucket, field, value, count(*) AS n, min(row_index) AS first_row FROM (
    SELECT bucket, row_index, 'mcc' AS field, mcc AS value FROM b
    UNION ALL SELECT bucket, row_index, 'currency', currency FROM b
    UNION ALL SELECT bucket, row_index, 'bank_category', bank_category FROM b)
  GROUP BY bucket, field, value),
cp AS (
  SELECT bucket, field, CAST(sum(n) AS BIGINT) AS present, arg_max(value, struct_pack(n := n, e := -first_row)) AS mode,
         max(n) / sum(n)::DOUBLE AS p_mode, sum(n) / max(bucket_size)::DOUBLE AS coverage
  FROM cc JOIN sizes USING (bucket) GROUP BY bucket, field),
inf AS (
  SELECT * FROM cp WHERE coverage >= 0.5 AND p_mode >= 0.5
   AND NOT EXISTS (SELECT 1 FROM used WHERE ubucket = bucket AND ufield = field)),
am AS (SELECT bucket, median(ln(abs(amount))) AS log_median, count(*) AS amount_n FROM b GROUP BY bucket),
ap AS (SELECT b.bucket, any_value(log_median) AS log_median, any_value(amount_n) AS amount_n, median(abs(ln(abs(amount)) - log_median)) AS log_mad
       FROM b JOIN am USING (bucket) GROUP BY b.bucket),
tok AS (
  SELECT DISTINCT w.p_partkey, token FROM won w, unnest(list_filter(string_split_regex(lower(description), '[^a-z0-9]+'),
         lambda t: regexp_full_match(t, '[a-z]{3,}'))) u(token)),
df AS (SELECT bucket, token, count(*) / any_value(bucket_size)::DOUBLE AS df FROM b JOIN tok USING (p_partkey) JOIN sizes USING (bucket) GROUP BY bucket, token),
core AS (SELECT DISTINCT bucket FROM df WHERE df >= 0.5),
word AS (SELECT p_partkey, least(1 - min(df), 0.5) AS a_word FROM tok JOIN won USING (p_partkey) JOIN df USING (bucket, token) GROUP BY p_partkey),
field AS (SELECT c.bucket, c.field, c.value, 1 - (c.n / i.present::DOUBLE) / i.p_mode AS a FROM inf i JOIN cc c USING (bucket, field)),
sc AS (
  SELECT b.row_index, b.bucket, bucket_size, coalesce(m.a, 0) AS a_mcc, coalesce(u.a, 0) AS a_currency, coalesce(k.a, 0) AS a_bank,
         CASE WHEN amount_n >= 5 AND log_mad >= 0.1 THEN least(greatest((abs(ln(abs(amount)) - log_median) / (1.4826 * log_mad) - 3) / 3, 0), 1) ELSE 0 END AS a_amount,
         CASE WHEN core.bucket IS NOT NULL THEN coalesce(a_word, 0) ELSE 0 END AS a_text
  FROM b JOIN sizes USING (bucket) JOIN ap USING (bucket) LEFT JOIN core USING (bucket) LEFT JOIN word USING (p_partkey)
  LEFT JOIN field m ON m.bucket = b.bucket AND m.field = 'mcc' AND m.value = b.mcc
  LEFT JOIN field u ON u.bucket = b.bucket AND u.field = 'currency' AND u.value = b.currency
  LEFT JOIN field k ON k.bucket = b.bucket AND k.field = 'bank_category' AND k.value = b.bank_category
  WHERE bucket_size >= 8)
"""


@query(
    "E13_categorical_profile_by_rule_set",
    with_(_SET_SCORED, "SELECT bucket, field, present, mode, round(p_mode, 9) AS p_mode, round(coverage, 9) AS coverage FROM cp"),
)
def e13_sets(spark: SparkSession, sf: str) -> DataFrame:
    prof = ty.categorical_profile(ty.facts(set_buckets(spark, sf)))
    return prof.withColumn("p_mode", F.round("p_mode", 9)).withColumn("coverage", F.round("coverage", 9))


@query(
    "E17_atypicality_by_rule_set",
    with_(
        _SET_SCORED,
        """SELECT row_index, bucket, bucket_size,
 round(1 - (1 - a_mcc) * (1 - a_currency) * (1 - a_bank) * (1 - a_amount) * (1 - a_text), 9) AS atypicality FROM sc""",
    ),
)
def e17_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(set_buckets(spark, sf), "set-buckets")
    profile = ty.fit(rows, ty.rule_fields_by_set(part_rules(spark, sf)))
    return ty.score(rows, profile).select("row_index", "bucket", "bucket_size", F.round("atypicality", 9).alias("atypicality"))


@query("E19_buckets", with_(BUCKETED, "SELECT bucket, bucket_size FROM sizes"))
def e19(spark: SparkSession, sf: str) -> DataFrame:
    return ty.bucket_sizes(ty.facts(bucketed(spark, sf)))


@query(
    "E19_draft_bucket",
    with_(TXN, "SELECT src_row FROM txn WHERE description LIKE '%ring%' AND bank_category = 'PROMO'"),
)
def e19_draft(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.operators.conditions import Condition

    draft = (Condition("description", "contains", "ring"), Condition("bank_category", "equals", "PROMO"))
    return ty.by_draft(txn(spark, sf), draft).select("src_row")


@query(
    "E22_flag_rates",
    with_(
        SCORED,
        "SELECT bucket, count(*) AS bucket_size, count(*) FILTER (WHERE atypicality >= 0.6) AS flagged, round(avg(CASE WHEN atypicality >= 0.6 THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS flag_rate FROM scored GROUP BY bucket",
    ),
)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    return ty.flag_rates(scored(spark, sf)).withColumn("flag_rate", F.round("flag_rate", 9))


@query(
    "H2_flagged_in_order",
    with_(SCORED, "SELECT src_row, round(atypicality, 9) AS atypicality FROM scored WHERE atypicality >= 0.6"),
)
def h2(spark: SparkSession, sf: str) -> DataFrame:
    rows = ty.flagged(scored(spark, sf)).orderBy(F.col("atypicality").desc(), "row_index")
    return rows.select("src_row", F.round("atypicality", 9).alias("atypicality"))


@query(
    "H3_reasons_by_rank",
    with_(
        SCORED,
        """SELECT src_row, array_to_string(list_filter([CASE WHEN a_mcc >= 0.5 THEN 'mcc' END, CASE WHEN a_amount >= 0.5 THEN 'amount' END, CASE WHEN a_description >= 0.5 THEN 'description' END,
 CASE WHEN a_counterparty >= 0.5 THEN 'counterparty' END, CASE WHEN a_currency >= 0.5 THEN 'currency' END, CASE WHEN a_bank_category >= 0.5 THEN 'bank_category' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM scored WHERE atypicality >= 0.6""",
    ),
)
def h3(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array_join(F.transform("reasons", lambda r: r["field"]), ",")
    return ty.flagged(scored(spark, sf)).select("src_row", names.alias("reasons"))


@query(
    "H4_atypical_first",
    with_(
        SCORED,
        "SELECT t.src_row, round(coalesce(CASE WHEN atypicality >= 0.6 THEN atypicality END, -1), 9) AS sort_score FROM txn t LEFT JOIN scored s ON s.src_row = t.src_row",
    ),
)
def h4(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.operators.review import atypical_first

    hits = ty.flagged(scored(spark, sf)).select("src_row", "atypicality")
    rows = indexed_txn(spark, sf).join(hits, "src_row", "left")
    return atypical_first(rows).select("src_row", F.round(F.coalesce("atypicality", F.lit(-1.0)), 9).alias("sort_score"))


@query(
    "H9_rare_tokens",
    with_(
        SCORED,
        """, f AS (SELECT t.bucket, t.row_index, t.token, df.df FROM tok t JOIN df USING (bucket, token) JOIN scored s ON s.bucket = t.bucket AND s.row_index = t.row_index WHERE atypicality >= 0.6),
 lo AS (SELECT bucket, row_index, min(df) AS low FROM f GROUP BY ALL)
SELECT row_index AS src_row, string_agg(token, ' ' ORDER BY token) AS rare_tokens FROM f JOIN lo USING (bucket, row_index) WHERE df = low GROUP BY row_index""",
    ),
)
def h9(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(bucketed(spark, sf), "bucketed")
    profile = ty.fit(rows, ty.rule_fields(RULES))
    hits = ty.flagged(ty.score(rows, profile))
    words = ty.rare_tokens(materialize(hits, "flagged"), ty.token_frequency(profile.facts))
    return words.select(F.col("row_index").alias("src_row"), "rare_tokens")


@query(
    "D15_rows_with_flags",
    with_(SCORED, "SELECT t.file_id, count(*) AS rows_, count(s.src_row) AS flagged FROM txn t LEFT JOIN (SELECT * FROM scored WHERE atypicality >= 0.6) s ON s.src_row = t.src_row GROUP BY t.file_id"),
)
def d15(spark: SparkSession, sf: str) -> DataFrame:
    hits = ty.flagged(scored(spark, sf)).select("src_row", F.lit(True).alias("flag"))
    return txn(spark, sf).join(hits, "src_row", "left").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("rows_"), F.count("flag").alias("flagged")
    )


@query(
    "I17_amount_multiple",
    with_(BUCKETED, "SELECT b.src_row, CAST(floor(abs(amount) / abs(raw_median) + 0.5) AS BIGINT) AS multiple FROM b JOIN ap ON ap.bucket = b.bucket AND ap.currency = b.currency"),
)
def i17(spark: SparkSession, sf: str) -> DataFrame:
    rows = bucketed(spark, sf)
    p = ty.amount_profile(materialize(ty.facts(rows), "facts")).select("bucket", "currency", "raw_median")
    return rows.join(p, ["bucket", "currency"]).select(
        "src_row", ty.amount_multiple(F.col("amount"), F.col("raw_median")).alias("multiple")
    )


@query(
    "I7_tokens",
    """SELECT doc_id, len(t) AS words, array_to_string(list_sort(list_distinct(t)), ' ') AS vocabulary FROM (
 SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: regexp_full_match(t, '[a-z]{3,}')) AS t FROM documents)""",
)
def i7(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    return d.select(
        "doc_id",
        F.size("t").cast("long").alias("words"),
        F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("vocabulary"),
    )


@query(
    "I8_log_amounts",
    with_(TXN, "SELECT src_row, round(ln(abs(amount)), 9) AS log_amount, least(greatest(round(amount / 50000, 9), 0.1), 1.0) AS clamped FROM txn"),
)
def i8(spark: SparkSession, sf: str) -> DataFrame:
    clamp = F.least(F.greatest(F.round(F.col("amount") / 50000, 9), F.lit(0.1)), F.lit(1.0))
    return txn(spark, sf).select("src_row", F.round(F.ln(F.abs("amount")), 9).alias("log_amount"), clamp.alias("clamped"))
