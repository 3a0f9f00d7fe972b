"""Queries on the rule grammar, first match, previews and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import categorize as cat
from ledgerloom.operators import rules as ops
from ledgerloom.operators.conditions import Condition, compile_conditions
from ledgerloom.sources.tables import read_table, spread
from ledgerloom.workload.adapters import (
    BASE,
    CATEGORIES,
    CATEGORY_SQL,
    HASHED,
    INDEXED,
    MARKS,
    PROPOSED,
    PROPOSED_SQL,
    RULE_SQL,
    RULES,
    TXN,
    categories,
    hashed_txn,
    indexed_txn,
    txn,
)
from ledgerloom.workload.registry import query, with_

# ------------------------------------------------------------- C: predicates

_DATE_TESTS = {
    "C1_first_day": (Condition("date", "firstDayOfMonth"), "day(date) = 1"),
    "C2_first_monday": (Condition("date", "firstMondayOfMonth"), "isodow(date) = 1 AND day(date) <= 7"),
    "C3_first_saturday": (Condition("date", "firstSaturdayOfMonth"), "isodow(date) = 6 AND day(date) <= 7"),
    "C4_first_sunday": (Condition("date", "firstSundayOfMonth"), "isodow(date) = 7 AND day(date) <= 7"),
    "C5_last_day": (Condition("date", "lastDayOfMonth"), "date = last_day(date)"),
    "C6_last_monday": (Condition("date", "lastMondayOfMonth"), "isodow(date) = 1 AND day(date) > day(last_day(date)) - 7"),
    "C7_last_saturday": (Condition("date", "lastSaturdayOfMonth"), "isodow(date) = 6 AND day(date) > day(last_day(date)) - 7"),
    "C8_last_sunday": (Condition("date", "lastSundayOfMonth"), "isodow(date) = 7 AND day(date) > day(last_day(date)) - 7"),
    "C9_specific_day": (Condition("date", "specificDay", 15), "day(date) = 15"),
    "C10_day_range": (Condition("date", "dayRange", lo=5, hi=9), "day(date) BETWEEN 5 AND 9"),
}
_OTHER_TESTS = {
    "C11_amount_equals": (Condition("amount", "equals", 80110.22, currency="UAH"), "amount = 80110.22 AND currency = 'UAH'"),
    "C12_amount_not_equals": (Condition("amount", "notEquals", 80110.22, currency="UAH"), "amount <> 80110.22 AND currency = 'UAH'"),
    "C13_amount_greater": (Condition("amount", "greaterThan", 50000, currency="EUR"), "amount > 50000 AND currency = 'EUR'"),
    "C14_amount_less": (Condition("amount", "lessThan", 5000, currency="EUR"), "amount < 5000 AND currency = 'EUR'"),
    "C15_amount_at_least": (Condition("amount", "greaterThanOrEqual", 50000, currency="GBP"), "amount >= 50000 AND currency = 'GBP'"),
    "C16_amount_at_most": (Condition("amount", "lessThanOrEqual", 5000, currency="GBP"), "amount <= 5000 AND currency = 'GBP'"),
    "C17_amount_between": (Condition("amount", "between", lo=1000, hi=2000, currency="USD"), "amount BETWEEN 1000 AND 2000 AND currency = 'USD'"),
    "C18_amount_with_currency": (Condition("amount", "greaterThan", 0, currency="UAH"), "currency = 'UAH' AND amount > 0"),
    "C19_text_equals": (Condition("description", "equals", "red widget"), "description = 'red widget'"),
    "C20_text_not_equals": (Condition("account", "notEquals", "ACC7"), "account <> 'ACC7'"),
    "C21_text_contains": (Condition("description", "contains", "bolt"), "description LIKE '%bolt%'"),
    "C22_text_not_contains": (Condition("counterparty", "notContains", "9"), "counterparty NOT LIKE '%9%'"),
    "C23_text_starts_with": (Condition("description", "startsWith", "cold"), "starts_with(description, 'cold')"),
    "C24_text_ends_with": (Condition("account", "endsWith", "4"), "suffix(account, '4')"),
    "C25_text_matches": (Condition("description", "matches", "^(hot|cold) [rp]"), "regexp_matches(description, '^(hot|cold) [rp]')"),
    "C27_match_equals": (Condition("mcc", "equals", "5011"), "mcc = '5011'"),
    "C28_match_not_equals": (Condition("currency", "notEquals", "USD"), "currency <> 'USD'"),
    "C29_match_one_of": (Condition("bank_category", "oneOf", values=("PROMO", "LARGE")), "bank_category IN ('PROMO','LARGE')"),
}


def _matched(rows: DataFrame, condition: Condition) -> DataFrame:
    return (
        rows.where(compile_conditions([condition]))
        .groupBy("currency")
        .agg(F.count(F.lit(1)).alias("matched"), F.sum("src_row").alias("row_checksum"))
    )


def _register_predicates() -> None:
    for name, (condition, test) in {**_DATE_TESTS, **_OTHER_TESTS}.items():
        sql = with_(
            TXN,
            "SELECT currency, count(*) AS matched, CAST(sum(src_row) AS BIGINT) AS row_checksum "
            f"FROM txn WHERE {test} GROUP BY currency",
        )
        query(name, sql)(lambda spark, sf, c=condition: _matched(txn(spark, sf), c))


_register_predicates()


def _side_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with its commission and cashback as operations of their own."""
    kinds = F.array(
        F.struct(F.lit("main").alias("k"), F.lit(True).alias("on")),
        F.struct(F.lit("commission").alias("k"), (F.col("commission") > 0).alias("on")),
        F.struct(F.lit("cashback").alias("k"), (F.col("cashback") > 0).alias("on")),
    )
    return (
        txn(spark, sf)
        .withColumn("kind", F.explode(F.filter(kinds, lambda k: k["on"])))
        .withColumn("kind", F.col("kind.k"))
        .withColumn("is_bank_commission", F.col("kind") == "commission")
        .withColumn("is_cashback", F.col("kind") == "cashback")
    )


_FLAGGED = TXN + """,
ftxn AS (
  SELECT * REPLACE (k = 'commission' AS is_bank_commission, k = 'cashback' AS is_cashback)
  FROM txn, (VALUES ('main'), ('commission'), ('cashback')) v(k)
  WHERE k = 'main' OR (k = 'commission' AND commission > 0) OR (k = 'cashback' AND cashback > 0))
"""
for _name, _field, _op, _sql in (
    ("C30_flag_is_true", "is_bank_commission", "isTrue", "is_bank_commission"),
    ("C31_flag_is_false", "is_cashback", "isFalse", "NOT is_cashback"),
):
    query(
        _name,
        with_(
            _FLAGGED,
            "SELECT currency, count(*) AS matched, CAST(sum(src_row) AS BIGINT) AS row_checksum "
            f"FROM ftxn WHERE {_sql} GROUP BY currency",
        ),
    )(lambda spark, sf, f=_field, o=_op: _matched(_side_flags(spark, sf), Condition(f, o)))


@query(
    "C32_and_of_conditions",
    with_(
        TXN,
        "SELECT currency, count(*) FILTER (WHERE description LIKE '%gear%' AND day(date) BETWEEN 1 AND 10 AND currency <> 'USD') AS matched, "
        "count(*) AS matched_by_empty_list FROM txn GROUP BY currency",
    ),
)
def c32(spark: SparkSession, sf: str) -> DataFrame:
    every = (
        Condition("description", "contains", "gear"),
        Condition("date", "dayRange", lo=1, hi=10),
        Condition("currency", "notEquals", "USD"),
    )
    return txn(spark, sf).groupBy("currency").agg(
        F.count_if(compile_conditions(every)).alias("matched"),
        F.count_if(compile_conditions([])).alias("matched_by_empty_list"),
    )


# --------------------------------------------------- rule sets derived from part


def part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule set per brand, one rule per part type and size of the brand.

    The rule order is the part type, then the larger size first; the category
    follows from the size.
    """
    p = read_table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(
        F.min("p_partkey").alias("part"), F.min("p_name").alias("name")
    )
    known = F.element_at(F.array(*[F.lit(c[0]) for c in CATEGORIES]), F.col("p_size") % 8 + 1)
    gone = F.col("p_size") == 50
    none = F.lit(None)

    def condition(field: str, operator: str, value=none, values=none, lo=none, hi=none) -> Column:
        return F.struct(
            F.lit(field).alias("field"),
            F.lit(operator).alias("operator"),
            value.cast("string").alias("value"),
            values.cast("array<string>").alias("values"),
            lo.cast("double").alias("lo"),
            hi.cast("double").alias("hi"),
            none.cast("string").alias("currency"),
        )

    mcc = F.lpad((F.col("p_size") + 5000).cast("string"), 4, "0")
    conditions = F.array(
        condition("bank_category", "equals", F.col("p_type")),
        F.when(F.col("p_size") <= 25, condition("mcc", "oneOf", values=F.array(mcc, F.lit("5001")))).otherwise(
            condition("description", "startsWith", F.substring_index("name", " ", 1))
        ),
    )
    order = F.row_number().over(W.partitionBy("p_brand").orderBy("p_type", F.col("p_size").desc())) - 1
    return p.select(
        F.col("p_brand").alias("ruleset_id"),
        F.col("part").alias("rule_id"),
        order.cast("long").alias("order"),
        F.when(gone, "retired").otherwise(known).alias("category_id"),
        conditions.alias("conditions"),
    )


_KNOWN = "(['" + "','".join(c[0] for c in CATEGORIES) + "'])"
PART_RULES = f"""
prules AS (
  SELECT p_brand AS ruleset_id, part AS rule_id,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size DESC) - 1 AS "order",
         CASE WHEN p_size = 50 THEN 'retired' ELSE {_KNOWN}[p_size % 8 + 1] END AS category_id,
         p_type, p_size, name, lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc_value,
         split_part(name, ' ', 1) AS first_word
  FROM (SELECT p_brand, p_type, p_size, min(p_partkey) AS part, min(p_name) AS name
        FROM part GROUP BY p_brand, p_type, p_size))
"""


def branded_txn(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions that belong to the rule set of their part's brand."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    li = spread(li, "l_orderkey")
    p = read_table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_brand").alias("ruleset_id"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("UAH").alias("currency"),
        F.col("p_name").alias("description"),
        F.lit(None).cast("string").alias("counterparty"),
        F.lit(None).cast("string").alias("account"),
        F.col("p_type").alias("bank_category"),
        F.lpad((F.col("p_size") + 5000).cast("string"), 4, "0").alias("mcc"),
        F.lit(False).alias("is_bank_commission"),
        F.lit(False).alias("is_cashback"),
    )


_BRANDED = PART_RULES + """,
btxn AS (
  SELECT p_brand AS ruleset_id, p_name AS description, p_type AS bank_category, l_extendedprice AS amount,
         lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc, row_number() OVER () AS id
  FROM lineitem JOIN part ON l_partkey = p_partkey),
won AS (
  SELECT t.id, t.ruleset_id, min_by(r.rule_id, r."order") AS rule_id, min_by(r.category_id, r."order") AS category_id
  FROM btxn t JOIN prules r ON t.ruleset_id = r.ruleset_id AND t.bank_category = r.p_type
   AND CASE WHEN r.p_size <= 25 THEN t.mcc IN (r.mcc_value, '5001') ELSE starts_with(t.description, r.first_word) END
  GROUP BY t.id, t.ruleset_id)
"""


@query(
    "D1_first_match",
    with_(
        TXN,
        f"SELECT src_row, CAST(rule_id AS BIGINT) AS rule_id, {CATEGORY_SQL} AS category_id "
        f"FROM (SELECT src_row, {RULE_SQL} AS rule_id FROM txn)",
    ),
)
def d1(spark: SparkSession, sf: str) -> DataFrame:
    return ops.with_rule(txn(spark, sf), RULES).select(
        "src_row", "rule_id", F.col("rule_category").alias("category_id")
    )


@query(
    "D1_first_match_by_rule_set",
    with_(
        _BRANDED,
        "SELECT ruleset_id, rule_id, category_id, count(*) AS applied FROM won GROUP BY ALL",
    ),
)
def d1_sets(spark: SparkSession, sf: str) -> DataFrame:
    return (
        ops.with_rule_by_set(branded_txn(spark, sf), part_rules(spark, sf))
        .where("rule_id is not null")
        .groupBy("ruleset_id", "rule_id", F.col("rule_category").alias("category_id"))
        .agg(F.count(F.lit(1)).alias("applied"))
    )


@query(
    "E6_applied_counts_by_rule_set",
    with_(
        _BRANDED,
        """SELECT r.ruleset_id, r.rule_id, count(w.id) AS applied_count
FROM prules r LEFT JOIN won w ON w.ruleset_id = r.ruleset_id AND w.rule_id = r.rule_id GROUP BY ALL""",
    ),
)
def e6_sets(spark: SparkSession, sf: str) -> DataFrame:
    return ops.applied_counts_by_set(branded_txn(spark, sf), part_rules(spark, sf))


def faulty_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule per part; seven of nine have a condition outside the grammar."""
    part = read_table(spark, sf, "part")
    shape = "field string, operator string, value string, values array<string>, lo double, hi double, currency string"
    kinds = [
        '{"field": "description", "operator": "matches", "value": "gear$"}',
        '{"field": "nope", "operator": "isFalse"}',
        '{"field": "mcc", "operator": "contains", "value": "5"}',
        '{"field": "amount", "operator": "greaterThan", "value": "5"}',
        '{"field": "description", "operator": "equals"}',
        '{"field": "currency", "operator": "oneOf"}',
        '{"field": "description", "operator": "matches", "value": "("}',
        '{"field": "description", "operator": "matches", "value": "(a+)+"}',
    ]
    text = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 9).cast("int"))
    return part.select(
        F.col("p_brand").alias("ruleset_id"),
        F.col("p_partkey").alias("rule_id"),
        F.lit(0).cast("long").alias("order"),
        F.lit("faulty").alias("category_id"),
        F.when(text.isNotNull(), F.array(F.from_json(text, shape))).alias("conditions"),
    )


@query(
    "D1_rule_errors",
    """
SELECT p_brand AS ruleset_id, p_partkey AS rule_id, 0 AS condition,
       ['unknown-field', 'unsupported-operator', 'amount-without-currency', 'missing-value', 'missing-value',
        'invalid-pattern', 'unsafe-pattern'][p_partkey % 9] AS reason
FROM part WHERE p_partkey % 9 BETWEEN 1 AND 7
""",
)
def d1_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rule_errors(faulty_rules(spark, sf))


@query(
    "D1_faulty_rules_are_left_out",
    with_(
        _BRANDED,
        """, own AS (
  SELECT ruleset_id, rule_id, "order" + 1 AS pos, id FROM won JOIN prules USING (ruleset_id, rule_id)),
rest AS (
  SELECT t.id, t.ruleset_id, min(p.p_partkey) AS rule_id
  FROM btxn t JOIN part p ON p.p_brand = t.ruleset_id AND (p.p_partkey % 9 = 8 OR p.p_partkey % 9 = 0 AND t.description LIKE '%gear')
  GROUP BY t.id, t.ruleset_id)
SELECT ruleset_id, rule_id, count(*) AS applied
FROM (SELECT t.ruleset_id, coalesce(r.rule_id, o.rule_id) AS rule_id
      FROM btxn t LEFT JOIN rest r ON r.id = t.id LEFT JOIN own o ON o.id = t.id)
WHERE rule_id IS NOT NULL GROUP BY ALL""",
    ),
)
def d1_faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty rules in front of each set: the valid ones among them win, then the set's own."""
    own = part_rules(spark, sf).withColumn("order", F.col("order") + 1)
    rules = faulty_rules(spark, sf).unionByName(own)
    won = ops.with_rule_by_set(branded_txn(spark, sf), rules).where("rule_id is not null")
    return won.groupBy("ruleset_id", "rule_id").agg(F.count(F.lit(1)).alias("applied"))


# -------------------------------------------------------------- C26, D11, D12 …


@query(
    "C26_unsafe_patterns",
    """
WITH pats AS (
  SELECT p_partkey AS rule_id, p_brand AS ruleset_id, p_size,
         CASE WHEN p_type = 'ECONOMY' THEN '(' || p_name || '+)+' WHEN p_type = 'LARGE' THEN '((' || p_name || '*)x)*'
              WHEN p_type = 'MEDIUM' THEN '[(]' || p_name || '+' WHEN p_type = 'PROMO' THEN '(' || p_name || ')+'
              WHEN p_type = 'SMALL' THEN '((' || p_name || ')+){2}' ELSE '\\(' || p_name || '+\\)+' END AS pattern,
         p_type IN ('ECONOMY', 'SMALL') AS unsafe
  FROM part)
SELECT ruleset_id, rule_id, pattern, unsafe FROM pats
""",
)
def c26(spark: SparkSession, sf: str) -> DataFrame:
    name, t = F.col("p_name"), F.col("p_type")
    wrap = lambda a, b: F.concat(F.lit(a), name, F.lit(b))
    pattern = (
        F.when(t == "ECONOMY", wrap("(", "+)+"))
        .when(t == "LARGE", wrap("((", "*)x)*"))
        .when(t == "MEDIUM", wrap("[(]", "+"))
        .when(t == "PROMO", wrap("(", ")+"))
        .when(t == "SMALL", wrap("((", ")+){2}"))
        .otherwise(wrap("\\(", "+\\)+"))
    )
    rules = read_table(spark, sf, "part").select(
        F.col("p_brand").alias("ruleset_id"),
        F.col("p_partkey").alias("rule_id"),
        F.array(F.struct(F.lit("matches").alias("operator"), pattern.alias("value"))).alias("conditions"),
    )
    return ops.unsafe_patterns(rules)


@query(
    "C37_valid_request_dates",
    """
SELECT month_text, count(*) AS dates,
       count(*) FILTER (WHERE regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') AND d >= '1999-01-01' AND d <= '2000-12-31') AS valid
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
             strftime(o_orderdate, '%Y-%m') AS month_text FROM orders) GROUP BY month_text
""",
)
def c37(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.sources.rates import requestable

    o = read_table(spark, sf, "orders")
    text = F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return (
        o.select(text.alias("d"), F.date_format("o_orderdate", "yyyy-MM").alias("month_text"))
        .groupBy("month_text")
        .agg(F.count(F.lit(1)).alias("dates"), F.count_if(requestable(F.col("d"), F.lit("2000-12-31"))).alias("valid"))
    )


_CATEGORY_DIM = "cats(id, name, currency, is_archived) AS (VALUES " + ", ".join(
    f"('{i}','{n}','{c}',{str(a).upper()})" for i, n, c, a in CATEGORIES
) + ")"


def customer_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A category per customer: archived when the balance is negative, with
    the base alias for one market segment."""
    c = read_table(spark, sf, "customer")
    return c.select(
        F.col("c_name").alias("id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "base").otherwise("UAH").alias("currency"),
        (F.col("c_acctbal") < 0).alias("is_archived"),
    )


@query(
    "C38_active_categories",
    "SELECT c_name AS id FROM customer WHERE NOT c_acctbal < 0",
)
def c38(spark: SparkSession, sf: str) -> DataFrame:
    return cat.active_categories(customer_categories(spark, sf)).select("id")


@query(
    "D17_base_alias",
    f"SELECT c_name AS id, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '{BASE}' ELSE 'UAH' END AS currency FROM customer",
)
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return cat.resolve_base_alias(customer_categories(spark, sf), BASE).select("id", "currency")


@query(
    "D11_rules_with_category",
    with_(PART_RULES, "SELECT ruleset_id, count(*) AS live_rules FROM prules WHERE category_id <> 'retired' GROUP BY ruleset_id"),
)
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return ops.live_rules(part_rules(spark, sf), categories(spark)).groupBy("ruleset_id").agg(
        F.count(F.lit(1)).alias("live_rules")
    )


def wanted_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The stored rules after a change: large sizes dropped, small ones moved
    to another category, and the order turned round."""
    r = part_rules(spark, sf)
    size = F.col("rule_size")
    sizes = read_table(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_size").alias("rule_size"))
    turned = F.row_number().over(W.partitionBy("ruleset_id").orderBy(F.col("order").desc())) - 1
    return (
        r.join(sizes, "rule_id")
        .where(size <= 40)
        .withColumn("category_id", F.when(size <= 5, "moved").otherwise(F.col("category_id")))
        .withColumn("order", turned.cast("long"))
        .drop("rule_size")
    )


@query(
    "D12_rule_set_diff",
    with_(
        PART_RULES,
        """, content AS (
  SELECT *, p_type || '|' || CASE WHEN p_size <= 25 THEN mcc_value ELSE first_word END AS demands FROM prules),
old AS (
  SELECT ruleset_id, rule_id, "order", category_id, demands,
         row_number() OVER (PARTITION BY ruleset_id, category_id, demands ORDER BY "order") AS nth
  FROM content),
turned AS (
  SELECT *, row_number() OVER (PARTITION BY ruleset_id ORDER BY "order" DESC) - 1 AS new_order
  FROM content WHERE p_size <= 40),
new AS (
  SELECT ruleset_id, new_order, CASE WHEN p_size <= 5 THEN 'moved' ELSE category_id END AS category_id, demands,
         row_number() OVER (PARTITION BY ruleset_id, CASE WHEN p_size <= 5 THEN 'moved' ELSE category_id END, demands
                            ORDER BY new_order) AS nth
  FROM turned)
SELECT ruleset_id, CASE WHEN o.rule_id IS NULL THEN 'insert' WHEN n.new_order IS NULL THEN 'delete' ELSE 'update' END AS op,
       o.rule_id AS old_id, o."order" AS old_order, n.new_order
FROM old o FULL JOIN new n USING (ruleset_id, category_id, demands, nth)""",
    ),
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return ops.rule_set_diff(part_rules(spark, sf), wanted_rules(spark, sf))


@query(
    "E21_next_order",
    with_(PART_RULES, 'SELECT ruleset_id, max("order") + 1 AS next_order FROM prules GROUP BY ruleset_id'),
)
def e21(spark: SparkSession, sf: str) -> DataFrame:
    return ops.next_order(part_rules(spark, sf))


@query(
    "G6_reorder_subset",
    with_(
        PART_RULES,
        """, listed AS (SELECT ruleset_id, rule_id, "order", row_number() OVER (PARTITION BY ruleset_id ORDER BY name, rule_id) AS turn,
  row_number() OVER (PARTITION BY ruleset_id ORDER BY "order") AS slot FROM prules WHERE p_type = 'PROMO')
SELECT p.ruleset_id, p.rule_id, coalesce(s."order", p."order") AS "order"
FROM prules p LEFT JOIN listed t ON p.ruleset_id = t.ruleset_id AND p.rule_id = t.rule_id
LEFT JOIN listed s ON s.ruleset_id = t.ruleset_id AND s.slot = t.turn
""",
    ),
)
def g6(spark: SparkSession, sf: str) -> DataFrame:
    rules = part_rules(spark, sf)
    promo = read_table(spark, sf, "part").where("p_type = 'PROMO'").groupBy("p_brand", "p_size").agg(
        F.min("p_partkey").alias("rule_id"), F.min("p_name").alias("name")
    )
    turn = F.row_number().over(W.partitionBy("p_brand").orderBy("name", "rule_id"))
    wanted = promo.select(F.col("p_brand").alias("ruleset_id"), "rule_id", turn.alias("position"))
    return ops.reorder_subset(rules, wanted).select("ruleset_id", "rule_id", "order")


@query(
    "G7_reorder_preview",
    with_(
        PART_RULES,
        """SELECT ruleset_id, rule_id, row_number() OVER (PARTITION BY ruleset_id
 ORDER BY CASE WHEN p_type = 'SMALL' THEN p_size END NULLS LAST, "order") - 1 AS "order" FROM prules""",
    ),
)
def g7(spark: SparkSession, sf: str) -> DataFrame:
    rules = part_rules(spark, sf)
    ranks = read_table(spark, sf, "part").where("p_type = 'SMALL'").groupBy("p_brand", "p_size").agg(
        F.min("p_partkey").alias("rule_id")
    )
    ranks = ranks.select(F.col("p_brand").alias("ruleset_id"), "rule_id", F.col("p_size").cast("long").alias("rank"))
    return ops.reorder_preview(rules, ranks).select("ruleset_id", "rule_id", "order")


@query(
    "H6_rules_in_order",
    with_(PART_RULES, 'SELECT ruleset_id, rule_id, "order" FROM prules'),
)
def h6(spark: SparkSession, sf: str) -> DataFrame:
    return part_rules(spark, sf).select("ruleset_id", "rule_id", "order").orderBy("ruleset_id", "order")


_SIGNATURE = """CASE WHEN p_size <= 25
  THEN 'bank_category|equals|value=' || p_type || chr(10) || 'mcc|oneOf|values=' || mcc_value || ';5001'
  ELSE 'bank_category|equals|value=' || p_type || chr(10) || 'description|startsWith|value=' || first_word END"""


@query(
    "I14_condition_signature",
    with_(PART_RULES, f"SELECT ruleset_id, rule_id, {_SIGNATURE} AS signature FROM prules"),
)
def i14(spark: SparkSession, sf: str) -> DataFrame:
    return ops.condition_signatures(part_rules(spark, sf))


def rule_edits(spark: SparkSession, sf: str) -> DataFrame:
    """An edit per rule: kind by part type; condition edits either reverse the
    list (no change) or drop its second condition."""
    r = part_rules(spark, sf)
    kind_of = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("rule_id"), F.col("p_type").alias("t"), F.col("p_size").alias("size")
    )
    t, size = F.col("t"), F.col("size")
    kind = (
        F.when(t == "ECONOMY", "delete")
        .when(t == "SMALL", "reorder")
        .when(t == "PROMO", "categoryOnly")
        .when(t == "LARGE", "editConditions")
        .when(t == "MEDIUM", "editConditions")
        .otherwise("keep")
    )
    after = F.when(t == "LARGE", F.reverse("conditions")).when(t == "MEDIUM", F.slice("conditions", 1, 1))
    edits = r.join(kind_of, "rule_id").select(
        "ruleset_id",
        "rule_id",
        kind.alias("kind"),
        F.lit("edited").alias("category_id"),
        F.col("conditions").alias("before"),
        after.alias("after"),
        F.when(t == "SMALL", size.cast("long")).alias("rank"),
    )
    appended = r.join(kind_of, "rule_id").where("t = 'STANDARD' and size <= 10").select(
        "ruleset_id",
        (F.col("rule_id") + 1_000_000_000).alias("rule_id"),
        F.lit("appendEnd").alias("kind"),
        F.lit("appended").alias("category_id"),
        F.col("conditions").alias("before"),
        F.col("conditions").alias("after"),
        F.lit(None).cast("long").alias("rank"),
    )
    return edits.where("kind <> 'keep'").unionByName(appended)


@query(
    "K4_edit_lanes",
    with_(
        PART_RULES,
        """SELECT ruleset_id, rule_id, CASE p_type WHEN 'ECONOMY' THEN 'delete' WHEN 'SMALL' THEN 'reorder' WHEN 'PROMO' THEN 'categoryOnly' ELSE 'editConditions' END AS kind,
 CASE p_type WHEN 'PROMO' THEN 'live' WHEN 'LARGE' THEN 'live' ELSE 'sandbox' END AS lane FROM prules WHERE p_type <> 'STANDARD'
UNION ALL SELECT ruleset_id, rule_id + 1000000000, 'appendEnd', 'live' FROM prules WHERE p_type = 'STANDARD' AND p_size <= 10""",
    ),
)
def k4(spark: SparkSession, sf: str) -> DataFrame:
    return ops.classify_edits(rule_edits(spark, sf)).select("ruleset_id", "rule_id", "kind", "lane")


@query(
    "K5_edited_rule_sets",
    with_(
        PART_RULES,
        """, k AS (
 SELECT ruleset_id, rule_id, CASE WHEN p_type = 'PROMO' THEN 'edited' ELSE category_id END AS category_id,
        CASE WHEN p_type = 'MEDIUM' THEN 1 ELSE 2 END AS n_conditions, 0 AS tail,
        CASE WHEN p_type = 'SMALL' THEN p_size END AS rank, "order" AS old
 FROM prules WHERE p_type <> 'ECONOMY'
 UNION ALL SELECT ruleset_id, rule_id + 1000000000, 'appended', 2, 1, NULL, NULL FROM prules WHERE p_type = 'STANDARD' AND p_size <= 10)
SELECT ruleset_id, rule_id, category_id, CAST(n_conditions AS BIGINT) AS n_conditions,
 row_number() OVER (PARTITION BY ruleset_id ORDER BY tail, rank NULLS LAST, old NULLS LAST, rule_id) - 1 AS "order" FROM k""",
    ),
)
def k5(spark: SparkSession, sf: str) -> DataFrame:
    out = ops.apply_edits(part_rules(spark, sf), rule_edits(spark, sf))
    return out.select("ruleset_id", "rule_id", "category_id", F.size("conditions").cast("long").alias("n_conditions"), "order")


@query(
    "J5_equal_condition_sets",
    with_(
        PART_RULES,
        """SELECT ruleset_id, count(*) AS edits, count(*) FILTER (WHERE p_type = 'LARGE') AS same_set
FROM prules WHERE p_type IN ('LARGE', 'MEDIUM') GROUP BY ruleset_id""",
    ),
)
def j5(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.operators.conditions import signature

    same = signature(F.col("before")) == signature(F.col("after"))
    return rule_edits(spark, sf).where("kind = 'editConditions'").groupBy("ruleset_id").agg(
        F.count(F.lit(1)).alias("edits"), F.count_if(same).alias("same_set")
    )


# ------------------------------------------------------- overrides and ladder


def stored_footprints(spark: SparkSession, sf: str, marked: DataFrame | None = None) -> DataFrame:
    """What an earlier import left in the store: returned lines, manual where
    the quantity is high, some with a category that is gone.

    ``marked``: the hashed rows with their marks, where the caller has them."""
    rows = (hashed_txn(spark, sf, *MARKS) if marked is None else marked).where("l_returnflag = 'R'")
    manual = F.col("l_quantity") >= 40
    category = (
        F.when(F.col("l_linenumber") == 7, "gone")
        .when(F.col("l_linenumber") == 6, F.lit(None))
        .when(manual, "gifts")
        .otherwise("food")
    )
    return rows.select(
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.col("amount").alias("amount_usd"),
        category.alias("category_id"),
        "hash",
        manual.cast("int").alias("is_manual"),
    )


STORED = HASHED + """,
stored AS (
  SELECT h.year, h.month, day(h.date) AS day, h.amount AS amount_usd, h.hash, h.src_row,
         CASE WHEN l_linenumber = 7 THEN 'gone' WHEN l_linenumber = 6 THEN NULL WHEN l_quantity >= 40 THEN 'gifts' ELSE 'food' END AS category_id,
         CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END AS is_manual
  FROM htxn h JOIN li ON li.src_row = h.src_row WHERE l_returnflag = 'R'),
""" + _CATEGORY_DIM


LADDER = STORED + f""",
ruled AS (SELECT *, {RULE_SQL} AS rule_id FROM htxn),
ladder AS (
  SELECT r.*, {CATEGORY_SQL} AS rule_category, s.category_id AS override_category, c.id AS valid_override,
         coalesce(c.id, {CATEGORY_SQL}) AS resolved
  FROM ruled r
  LEFT JOIN (SELECT * FROM stored WHERE is_manual = 1 AND category_id IS NOT NULL) s
    ON r.hash = s.hash AND r.year = s.year AND r.month = s.month
  LEFT JOIN cats c ON c.id = s.category_id)
"""


def laddered(spark: SparkSession, sf: str, dump: str | None = None) -> DataFrame:
    marked = hashed_txn(spark, sf, *MARKS)
    overrides = store_overrides(spark, sf, marked)
    return cat.categorize(marked.drop(*MARKS), RULES, overrides, categories(spark), dump)


def store_overrides(spark: SparkSession, sf: str, marked: DataFrame) -> DataFrame:
    return cat.manual_overrides(stored_footprints(spark, sf, marked), cat.periods(marked))


@query(
    "D2_manual_overrides",
    with_(LADDER, "SELECT src_row, override_category FROM ladder WHERE override_category IS NOT NULL"),
)
def d2(spark: SparkSession, sf: str) -> DataFrame:
    marked = hashed_txn(spark, sf, *MARKS)
    rows = cat.with_period(marked)
    return rows.join(store_overrides(spark, sf, marked), ["hash", "year", "month"]).select("src_row", "override_category")


@query(
    "D3_dangling_override_falls_through",
    with_(
        LADDER,
        "SELECT src_row, override_category, resolved AS category_id FROM ladder WHERE override_category IS NOT NULL AND valid_override IS NULL",
    ),
)
def d3(spark: SparkSession, sf: str) -> DataFrame:
    rows = laddered(spark, sf).where("override_category is not null and valid_override is null")
    return rows.select("src_row", "override_category", "category_id")


@query(
    "D4_category_ladder",
    with_(
        LADDER,
        "SELECT src_row, coalesce(resolved, 'other') AS category_id, CASE WHEN override_category IS NOT NULL THEN 1 ELSE 0 END AS is_manual FROM ladder",
    ),
)
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return laddered(spark, sf, "other").select("src_row", "category_id", "is_manual")


@query(
    "D13_rule_preview_diff",
    with_(
        TXN,
        f"SELECT src_row, old_category, new_category FROM (SELECT src_row, {CATEGORY_SQL} AS old_category, {PROPOSED_SQL} AS new_category "
        f"FROM (SELECT *, {RULE_SQL} AS rule_id FROM txn)) WHERE old_category IS DISTINCT FROM new_category",
    ),
)
def d13(spark: SparkSession, sf: str) -> DataFrame:
    by_category = lambda r: r.category_id
    changed = cat.changed_rows(
        txn(spark, sf), ops.first_match(RULES, by_category), ops.first_match(PROPOSED, by_category)
    )
    return changed.select("src_row", "old_category", "new_category")


@query(
    "C35_changed_only",
    with_(
        TXN,
        f"SELECT file_id, count(*) AS changed FROM (SELECT file_id, {CATEGORY_SQL} AS old_category, {PROPOSED_SQL} AS new_category "
        f"FROM (SELECT *, {RULE_SQL} AS rule_id FROM txn)) WHERE old_category IS DISTINCT FROM new_category GROUP BY file_id",
    ),
)
def c35(spark: SparkSession, sf: str) -> DataFrame:
    by_category = lambda r: r.category_id
    changed = cat.changed_rows(
        txn(spark, sf), ops.first_match(RULES, by_category), ops.first_match(PROPOSED, by_category)
    )
    return changed.groupBy("file_id").agg(F.count(F.lit(1)).alias("changed"))


@query(
    "K3_previous_and_new_category",
    with_(
        LADDER,
        f"""SELECT src_row, coalesce(valid_override, {PROPOSED_SQL}) AS category_id,
 CASE WHEN coalesce(valid_override, {PROPOSED_SQL}) IS DISTINCT FROM resolved THEN resolved END AS previous_category_id,
 coalesce(valid_override, {PROPOSED_SQL}) IS DISTINCT FROM resolved AS changed FROM ladder""",
    ),
)
def k3(spark: SparkSession, sf: str) -> DataFrame:
    live = laddered(spark, sf)
    proposed = F.coalesce("valid_override", ops.first_match(PROPOSED, lambda r: r.category_id))
    both = live.withColumn("_new", proposed)
    changed = ~F.col("_new").eqNullSafe(F.col("category_id"))
    return both.select(
        "src_row",
        F.col("_new").alias("category_id"),
        F.when(changed, F.col("category_id")).alias("previous_category_id"),
        changed.alias("changed"),
    )


_DRAFT = (Condition("description", "contains", "o"), Condition("currency", "oneOf", values=("EUR", "UAH")))
_DRAFT_SQL = "description LIKE '%o%' AND currency IN ('EUR','UAH')"


@query(
    "C33_uncategorized_segment",
    with_(LADDER, "SELECT file_id, count(*) AS uncategorized FROM ladder WHERE resolved IS NULL GROUP BY file_id"),
)
def c33(spark: SparkSession, sf: str) -> DataFrame:
    return cat.uncategorized(laddered(spark, sf)).groupBy("file_id").agg(F.count(F.lit(1)).alias("uncategorized"))


@query(
    "C34_draft_filter",
    with_(TXN, f"SELECT file_id, count(*) AS drafted, CAST(sum(src_row) AS BIGINT) AS row_checksum FROM txn WHERE {_DRAFT_SQL} GROUP BY file_id"),
)
def c34(spark: SparkSession, sf: str) -> DataFrame:
    return cat.draft_matches(txn(spark, sf), _DRAFT).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("drafted"), F.sum("src_row").alias("row_checksum")
    )


@query(
    "E6_applied_counts",
    with_(
        TXN,
        "SELECT CAST(r.rule_id AS BIGINT) AS rule_id, r.category_id, count(t.rule_id) AS applied_count FROM (VALUES "
        + ", ".join(f"({r.rule_id}, '{r.category_id}')" for r in RULES)
        + f") r(rule_id, category_id) LEFT JOIN (SELECT {RULE_SQL} AS rule_id FROM txn) t USING (rule_id) GROUP BY ALL",
    ),
)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return ops.applied_counts(txn(spark, sf), RULES).select("rule_id", "category_id", "applied_count")


@query(
    "E7_window_counts",
    with_(
        LADDER,
        f"""SELECT file_id, count(*) FILTER (WHERE {_DRAFT_SQL}) AS match_count,
 count(*) FILTER (WHERE {_DRAFT_SQL} AND resolved IS NULL) AS uncat_total,
 count(*) FILTER (WHERE resolved IS NULL) AS remainder_count FROM ladder GROUP BY file_id""",
    ),
)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return cat.window_counts(laddered(spark, sf), _DRAFT)


# What each field is compared with, and how.
_FIELD_KINDS = """(VALUES
 ('date', 'day', 'firstDayOfMonth,firstMondayOfMonth,firstSaturdayOfMonth,firstSundayOfMonth,lastDayOfMonth,lastMondayOfMonth,lastSaturdayOfMonth,lastSundayOfMonth,specificDay,dayRange'),
 ('amount', 'num', 'equals,notEquals,greaterThan,lessThan,greaterThanOrEqual,lessThanOrEqual,between'),
 ('description', 'text', 'equals,notEquals,contains,notContains,startsWith,endsWith,matches'),
 ('counterparty', 'text', 'equals,notEquals,contains,notContains,startsWith,endsWith,matches'),
 ('account', 'text', 'equals,notEquals,contains,notContains,startsWith,endsWith,matches'),
 ('currency', 'optone', 'equals,notEquals,oneOf'), ('bank_category', 'optset', 'equals,notEquals,oneOf'), ('mcc', 'code', 'equals,notEquals,oneOf')
) v(field, value_kind, operators)"""


@query(
    "E8_condition_fields",
    with_(
        TXN,
        """, f AS (SELECT file_id, count(DISTINCT currency) > 1 AS many FROM txn GROUP BY file_id)
SELECT file_id, field, value_kind, operators FROM f, {kinds} WHERE many OR field <> 'currency'""".format(kinds=_FIELD_KINDS),
    ),
)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    return cat.condition_fields(txn(spark, sf)).select("file_id", "field", "value_kind", "operators")


@query(
    "E8_condition_fields_by_account",
    with_(
        TXN,
        """, f AS (SELECT account, count(DISTINCT currency) > 1 AS many FROM txn GROUP BY account)
SELECT account, field, value_kind, operators FROM f, {kinds} WHERE many OR field <> 'currency'""".format(kinds=_FIELD_KINDS),
    ),
)
def e8_account(spark: SparkSession, sf: str) -> DataFrame:
    rows = txn(spark, sf).withColumn("acct", F.col("account"))
    return cat.condition_fields(rows, "acct").select(F.col("acct").alias("account"), "field", "value_kind", "operators")


@query(
    "E9_option_list",
    with_(INDEXED, "SELECT file_id, mcc AS value, min(row_index) AS first_row FROM itxn GROUP BY file_id, mcc"),
)
def e9(spark: SparkSession, sf: str) -> DataFrame:
    return cat.options(indexed_txn(spark, sf), "mcc")


@query(
    "E12_completeness",
    with_(
        LADDER,
        "SELECT file_id, count(*) FILTER (WHERE resolved IS NULL) = 0 AS complete, count(*) FILTER (WHERE resolved IS NULL) AS remaining FROM ladder GROUP BY file_id",
    ),
)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    return cat.completeness(laddered(spark, sf))


# ------------------------------------------------------------------- explain

@query(
    "K1_decision_trace",
    with_(
        TXN,
        f""", r AS (SELECT src_row, coalesce({RULE_SQL}, 99) AS w FROM txn)
SELECT src_row, array_to_string([CASE WHEN k < w THEN 'miss' WHEN k = w THEN 'win' ELSE 'neutral' END for k in range(1, 13)], ',') AS trace FROM r""",
    ),
)
def k1(spark: SparkSession, sf: str) -> DataFrame:
    traced = ops.with_trace(txn(spark, sf), RULES)
    return traced.select("src_row", F.array_join(F.transform("trace", lambda r: r["status"]), ",").alias("trace"))


@query(
    "K2_why_tree",
    with_(
        LADDER,
        """SELECT src_row, override_category AS manual_category,
 CASE WHEN override_category IS NULL THEN CAST(rule_id AS BIGINT) END AS winner_rule_id,
 CASE WHEN coalesce(rule_id, 99) < 3 THEN '-' WHEN description LIKE '%anvil%' THEN
   CASE WHEN mcc IN ('5005','5006','5007','5010','5011') THEN 'true,true' ELSE 'true,false' END ELSE 'false,-' END AS rule3_met
FROM ladder""",
    ),
)
def k2(spark: SparkSession, sf: str) -> DataFrame:
    rows = laddered(spark, sf)
    told = ops.why(rows, RULES, F.col("override_category"))
    met = F.transform(F.get("trace", F.lit(2))["met"], lambda b: F.coalesce(b.cast("string"), F.lit("-")))
    return told.select("src_row", "manual_category", "winner_rule_id", F.array_join(met, ",").alias("rule3_met"))



# ------------------------------------------------- by rule set, rules as data

_PER_PART = PART_RULES + """,
parts AS (SELECT p_partkey, p_brand, p_type, p_name, lpad(CAST(5000 + p_size AS VARCHAR), 4, '0') AS mcc FROM part),
tested AS (
  SELECT p.p_partkey, r.*, p.p_type = r.p_type AS c1,
         CASE WHEN r.p_size <= 25 THEN p.mcc IN (r.mcc_value, '5001') ELSE starts_with(p.p_name, r.first_word) END AS c2
  FROM parts p JOIN prules r ON p.p_brand = r.ruleset_id),
winner AS (SELECT p_partkey, min("order") FILTER (c1 AND c2) AS w, min_by(rule_id, "order") FILTER (c1 AND c2) AS winner_rule_id,
                  min_by(category_id, "order") FILTER (c1 AND c2) AS rule_category FROM tested GROUP BY p_partkey),
shown AS (
  SELECT p_partkey, w, winner_rule_id, sha256(string_agg(rule_id || CASE WHEN "order" > coalesce(w, 1000000) THEN ' neutral -,-'
         ELSE CASE WHEN "order" = w THEN ' win ' ELSE ' miss ' END || CASE WHEN c1 THEN 'true,' || c2 ELSE 'false,-' END END, ';' ORDER BY "order")) AS trace
  FROM tested JOIN winner USING (p_partkey) GROUP BY ALL)
"""


def _trace_text() -> Column:
    met = lambda r: F.array_join(F.transform(r["met"], lambda b: F.coalesce(b.cast("string"), F.lit("-"))), ",")
    one = lambda r: F.concat_ws(" ", r["rule_id"].cast("string"), r["status"], met(r))
    return F.sha2(F.array_join(F.transform("trace", one), ";"), 256).alias("trace")


@query(
    "K1_decision_trace_by_rule_set",
    with_(_PER_PART, "SELECT l_orderkey, l_linenumber, trace FROM lineitem JOIN shown ON l_partkey = p_partkey"),
)
def k1_sets(spark: SparkSession, sf: str) -> DataFrame:
    """All rules, statuses and flags of each row's trace, as a digest."""
    traced = ops.with_trace_by_set(branded_txn(spark, sf), part_rules(spark, sf), [_trace_text()])
    return traced.select("l_orderkey", "l_linenumber", "trace")


@query(
    "K2_why_tree_by_rule_set",
    with_(
        _PER_PART,
        """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'gifts' END AS manual_category,
 CASE WHEN l_linenumber % 3 <> 0 THEN winner_rule_id END AS winner_rule_id, trace FROM lineitem JOIN shown ON l_partkey = p_partkey""",
    ),
)
def k2_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line of an order has a manual decision."""
    manual = F.when(F.col("l_linenumber") % 3 == 0, "gifts")
    told = ops.why(branded_txn(spark, sf), part_rules(spark, sf), manual, [_trace_text()])
    return told.select("l_orderkey", "l_linenumber", "manual_category", "winner_rule_id", "trace")


def proposed_part_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rule sets with the rules of the category "food" gone and all others of the first part type moved behind."""
    rules = part_rules(spark, sf).where("category_id <> 'food'")
    economy = F.col("conditions")[0]["value"] == "ECONOMY"
    return rules.withColumn("order", F.when(economy, F.col("order") + 100_000).otherwise(F.col("order")))


_SET_PREVIEW = _PER_PART + """,
newly AS (SELECT p_partkey, min_by(category_id, "order") AS new_category FROM tested WHERE c1 AND c2 AND category_id <> 'food' GROUP BY p_partkey),
preview AS (SELECT l_orderkey, l_linenumber, l_partkey, rule_category AS old_category, new_category
            FROM lineitem JOIN winner w ON l_partkey = w.p_partkey LEFT JOIN newly n ON l_partkey = n.p_partkey)
"""


@query(
    "D13_rule_preview_diff_by_rule_set",
    with_(_SET_PREVIEW, "SELECT l_orderkey, l_linenumber, old_category, new_category FROM preview WHERE old_category IS DISTINCT FROM new_category"),
)
def d13_sets(spark: SparkSession, sf: str) -> DataFrame:
    changed = cat.changed_rows_by_set(branded_txn(spark, sf), part_rules(spark, sf), proposed_part_rules(spark, sf))
    return changed.select("l_orderkey", "l_linenumber", "old_category", "new_category")


def set_overrides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Branded rows with a hash, and the decisions stored for every seventh order, some of a category that is gone."""
    rows = branded_txn(spark, sf).withColumn("hash", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    marked = cat.with_period(rows).where("l_orderkey % 7 = 0")
    decided = F.when(F.col("l_linenumber") % 2 == 0, "gone").otherwise("gifts")
    return rows, marked.select("hash", "year", "month", F.lit(1).alias("is_manual"), decided.alias("category_id")).distinct()


_SET_LADDER = _PER_PART + """,
ladder AS (
  SELECT l_orderkey, l_linenumber, l_orderkey % 7 = 0 AS stored, rule_category,
         CASE WHEN l_orderkey % 7 = 0 AND l_linenumber % 2 <> 0 THEN 'gifts' END AS valid_override
  FROM lineitem JOIN winner ON l_partkey = p_partkey)
"""


@query(
    "D4_category_ladder_by_rule_set",
    with_(
        _SET_LADDER,
        "SELECT l_orderkey, l_linenumber, coalesce(valid_override, rule_category, 'other') AS category_id, CASE WHEN stored THEN 1 ELSE 0 END AS is_manual FROM ladder",
    ),
)
def d4_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = set_overrides(spark, sf)
    overrides = cat.manual_overrides(stored, cat.periods(rows))
    told = cat.categorize(rows, part_rules(spark, sf), overrides, categories(spark), "other")
    return told.select("l_orderkey", "l_linenumber", "category_id", "is_manual")


@query(
    "K3_previous_and_new_category_by_rule_set",
    with_(
        _SET_PREVIEW,
        """SELECT l_orderkey, l_linenumber, new_category AS category_id,
 CASE WHEN new_category IS DISTINCT FROM old_category THEN old_category END AS previous_category_id,
 new_category IS DISTINCT FROM old_category AS changed FROM preview""",
    ),
)
def k3_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.with_rule_by_set(branded_txn(spark, sf), part_rules(spark, sf)).withColumnRenamed("rule_category", "_old").drop("rule_id")
    both = ops.with_rule_by_set(rows, proposed_part_rules(spark, sf))
    changed = ~F.col("rule_category").eqNullSafe(F.col("_old"))
    return both.select(
        "l_orderkey",
        "l_linenumber",
        F.col("rule_category").alias("category_id"),
        F.when(changed, F.col("_old")).alias("previous_category_id"),
        changed.alias("changed"),
    )
