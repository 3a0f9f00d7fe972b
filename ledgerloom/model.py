"""Schemas and constants of the statement data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column definitions a statement column can be mapped to (fixed values).
DATE = "DATE"
AMOUNT = "AMOUNT"
CURRENCY = "CURRENCY"
DESCRIPTION = "DESCRIPTION"
CATEGORY = "CATEGORY"
BALANCE = "BALANCE"
BANK_ACCOUNT = "BANK_ACCOUNT"
STATUS = "STATUS"
EXCHANGE_RATE = "EXCHANGE_RATE"
BANK_COMMISSION = "BANK_COMMISSION"
CASHBACK = "CASHBACK"
MERCHANT_CATEGORY = "MERCHANT_CATEGORY"
TIME = "TIME"
COUNTERPARTY = "COUNTERPARTY"
IGNORE = "IGNORE"

TEXT_DEFINITIONS = (DESCRIPTION, CATEGORY, BANK_ACCOUNT, COUNTERPARTY)
NUMBER_DEFINITIONS = (BALANCE, EXCHANGE_RATE, BANK_COMMISSION, CASHBACK)
DROPPED_DEFINITIONS = (TIME, IGNORE)

# Gate defaults (fixed values).
MAX_COLUMN_ERROR_RATIO = 0.3
MIN_DATE_PARSE_PERCENT = 90.0
STATUS_DOMINANCE = 0.8

PARAMS = T.StructType(
    [
        T.StructField("format", T.StringType()),
        T.StructField("amount_type", T.StringType()),
        T.StructField("currency_mode", T.StringType()),
        T.StructField("currency_code", T.StringType()),
        T.StructField("success_value", T.StringType()),
    ]
)

MAPPING = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("col_id", T.IntegerType()),
        T.StructField("definition", T.StringType()),
        T.StructField("params", PARAMS),
        T.StructField("recall_state", T.StringType()),
    ]
)

CONDITION = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("currency", T.StringType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("ruleset_id", T.StringType()),
        T.StructField("rule_id", T.LongType()),
        T.StructField("order", T.LongType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
    ]
)

ISSUE_COLUMNS = ("file_id", "row", "column", "what", "raw", "action")

FOOTPRINT = T.StructType(
    [
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("amount_usd", T.DoubleType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("is_manual", T.IntegerType()),
    ]
)
FOOTPRINT_KEY = ("hash", "year", "month")
