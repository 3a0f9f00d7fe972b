"""Rule conditions compiled to Columns.

Two forms share one grammar. ``compile_*`` turns literal rules into generated
code (a CASE chain). ``matches`` evaluates conditions that are data, with one
expression per row and no pairing of rows with rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions.text import trimmed

# Legal operators per field.
DATE_OPERATORS = (
    "firstDayOfMonth", "firstMondayOfMonth", "firstSaturdayOfMonth", "firstSundayOfMonth",
    "lastDayOfMonth", "lastMondayOfMonth", "lastSaturdayOfMonth", "lastSundayOfMonth",
    "specificDay", "dayRange",
)
NUMBER_OPERATORS = (
    "equals", "notEquals", "greaterThan", "lessThan",
    "greaterThanOrEqual", "lessThanOrEqual", "between",
)
TEXT_OPERATORS = ("equals", "notEquals", "contains", "notContains", "startsWith", "endsWith", "matches")
MATCH_OPERATORS = ("equals", "notEquals", "oneOf")
BOOLEAN_OPERATORS = ("isTrue", "isFalse")

FIELD_OPERATORS = {
    "date": DATE_OPERATORS,
    "amount": NUMBER_OPERATORS,
    "description": TEXT_OPERATORS,
    "counterparty": TEXT_OPERATORS,
    "account": TEXT_OPERATORS,
    "currency": MATCH_OPERATORS,
    "bank_category": MATCH_OPERATORS,
    "mcc": MATCH_OPERATORS,
    "is_bank_commission": BOOLEAN_OPERATORS,
    "is_cashback": BOOLEAN_OPERATORS,
}
VALUE_KINDS = {
    "date": "day", "amount": "num", "description": "text", "counterparty": "text", "account": "text",
    "currency": "optone", "bank_category": "optset", "mcc": "code",
    "is_bank_commission": "bool", "is_cashback": "bool",
}


class InvalidCondition(ValueError):
    """A condition outside the grammar."""


class UnsafePattern(InvalidCondition):
    """A quantified group with an unbounded quantifier inside."""


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: str | float | None = None
    values: tuple[str, ...] = ()
    lo: float | None = None
    hi: float | None = None
    currency: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: int
    order: int
    category_id: str
    conditions: tuple[Condition, ...] = field(default_factory=tuple)


# One group whose body holds an unbounded quantifier and that is itself
# quantified. Escapes and character classes are blanked beforehand.
_LITERALS = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]", re.S)
_INNERMOST = re.compile(r"\(([^()]*)\)([*+?{]?)")


def check_pattern(pattern: str) -> None:
    """Reject the plainly explosive shape of nested quantifiers."""
    text = _LITERALS.sub("x", pattern)
    while found := _INNERMOST.search(text):
        body, quantifier = found.groups()
        loops = re.search(r"[*+{]", body) is not None
        if loops and quantifier:
            raise UnsafePattern(pattern)
        # A quantifier inside stays visible to the group around only when it
        # is that group's own, so the closed group becomes one plain letter.
        text = text[: found.start()] + "x" + text[found.end() - len(quantifier) :]


def _date(c: Condition, d: Column) -> Column:
    last = F.last_day(d)
    simple = {
        "firstDayOfMonth": lambda: F.dayofmonth(d) == 1,
        "firstMondayOfMonth": lambda: dates.is_first_weekday(d, 0),
        "firstSaturdayOfMonth": lambda: dates.is_first_weekday(d, 5),
        "firstSundayOfMonth": lambda: dates.is_first_weekday(d, 6),
        "lastDayOfMonth": lambda: d == last,
        "lastMondayOfMonth": lambda: dates.is_last_weekday(d, 0),
        "lastSaturdayOfMonth": lambda: dates.is_last_weekday(d, 5),
        "lastSundayOfMonth": lambda: dates.is_last_weekday(d, 6),
        "specificDay": lambda: F.dayofmonth(d) == int(c.value),
        "dayRange": lambda: F.dayofmonth(d).between(int(c.lo), int(c.hi)),
    }
    return simple[c.operator]()


def _number(c: Condition, x: Column) -> Column:
    if c.operator == "between":
        return x.between(float(c.lo), float(c.hi))
    v = F.lit(float(c.value))
    return {
        "equals": x == v,
        "notEquals": x != v,
        "greaterThan": x > v,
        "lessThan": x < v,
        "greaterThanOrEqual": x >= v,
        "lessThanOrEqual": x <= v,
    }[c.operator]


def _text(c: Condition, x: Column) -> Column:
    value = str(c.value)
    if c.operator == "matches":
        check_pattern(value)
        return x.rlike(value)
    return {
        "equals": x == value,
        "notEquals": x != value,
        "contains": x.contains(value),
        "notContains": ~x.contains(value),
        "startsWith": x.startswith(value),
        "endsWith": x.endswith(value),
    }[c.operator]


def compile_condition(c: Condition) -> Column:
    """One condition as a boolean Column; null text behaves as empty text."""
    if c.operator not in FIELD_OPERATORS.get(c.field, ()):
        raise InvalidCondition(f"{c.field} does not support {c.operator}")
    col = F.col(c.field)
    if c.field == "date":
        return F.coalesce(_date(c, col), F.lit(False))
    if c.field == "amount":
        if not (c.currency or "").strip():
            raise InvalidCondition("an amount condition needs a currency")
        return F.coalesce(_number(c, col) & (F.col("currency") == c.currency), F.lit(False))
    if c.operator in BOOLEAN_OPERATORS:
        return col.eqNullSafe(F.lit(c.operator == "isTrue"))
    text = F.coalesce(col, F.lit(""))
    if c.operator == "oneOf":
        return text.isin(*[str(v) for v in c.values])
    return _text(c, text)


def compile_conditions(conditions: Sequence[Condition]) -> Column:
    """AND of all conditions; an empty list matches every row."""
    return reduce(lambda a, b: a & b, [compile_condition(c) for c in conditions], F.lit(True))


# ---------------------------------------------------------------- data form


TEXT_FIELDS = ("description", "counterparty", "account", "currency", "bank_category", "mcc")
_CODES = (*dict.fromkeys((*MATCH_OPERATORS, *TEXT_OPERATORS, *BOOLEAN_OPERATORS, *NUMBER_OPERATORS, *DATE_OPERATORS)),)


def _code(operator: str) -> int:
    return _CODES.index(operator)


def prepared(c: Column) -> Column:
    """A condition with numbers for its field and operator, parsed once.

    ``slot`` is the place of a text field, -1 the date, -2 the amount, -3 and
    -4 the flags.
    """
    field_ = c["field"]
    slot = F.coalesce(
        *[F.when(field_ == f, F.lit(i)) for i, f in enumerate(TEXT_FIELDS)],
        F.when(field_ == "date", -1),
        F.when(field_ == "amount", -2),
        F.when(field_ == "is_bank_commission", -3),
        F.when(field_ == "is_cashback", -4),
    )
    return F.struct(
        slot.alias("slot"),
        (F.array_position(F.array(*[F.lit(o) for o in _CODES]), c["operator"]) - 1).cast("int").alias("op"),
        c["value"].alias("value"),
        c["value"].try_cast("double").alias("number"),
        c["values"].alias("values"),
        c["lo"].alias("lo"),
        c["hi"].alias("hi"),
        c["currency"].alias("currency"),
    )


def nests_quantifiers(pattern: Column) -> Column:
    """``check_pattern`` for patterns that are data.

    Literals are blanked, then the innermost groups are closed one level per
    step.
    """
    plain = F.regexp_replace(pattern, r"\\.|\[(?:\\.|[^\]\\])*\]", "x")
    nested = r"\([^()]*[*+{][^()]*\)[*+?{]"
    depth = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(plain, F.lit(r"\("))))
    walked = F.aggregate(
        depth,
        F.struct(plain.alias("text"), F.lit(False).alias("bad")),
        lambda acc, _: F.struct(
            F.regexp_replace(acc["text"], r"\([^()]*\)", "x").alias("text"),
            (acc["bad"] | acc["text"].rlike(nested)).alias("bad"),
        ),
    )
    return walked["bad"]


def condition_problem(c: Column) -> Column:
    """Why a condition that is data is outside the grammar; null where it is not.

    These are the conditions that the literal form refuses to compile.
    """
    field_, operator, value = c["field"], c["operator"], c["value"]
    known = F.coalesce(field_.isin(*FIELD_OPERATORS), F.lit(False))
    legal = reduce(
        lambda a, b: a | b, [(field_ == f) & operator.isin(*ops) for f, ops in FIELD_OPERATORS.items()]
    )
    pattern = operator == "matches"
    reads = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), value, F.lit("")).isNotNull()
    numeric = field_.isin("date", "amount")
    bounded = operator.isin("between", "dayRange")
    needs_number = numeric & operator.isin(*(o for o in NUMBER_OPERATORS if o != "between"), "specificDay")
    needs_text = ~numeric & ~operator.isin("oneOf", *BOOLEAN_OPERATORS)
    return (
        F.when(~known, "unknown-field")
        .when(~F.coalesce(legal, F.lit(False)), "unsupported-operator")
        .when((field_ == "amount") & (trimmed(F.coalesce(c["currency"], F.lit(""))) == ""), "amount-without-currency")
        .when(bounded & (c["lo"].isNull() | c["hi"].isNull()), "missing-value")
        .when(needs_number & value.try_cast("double").isNull(), "missing-value")
        .when((needs_text & value.isNull()) | ((operator == "oneOf") & c["values"].isNull()), "missing-value")
        .when(pattern & ~reads, "invalid-pattern")
        .when(pattern & nests_quantifiers(value), "unsafe-pattern")
    )


def row_texts() -> Column:
    """The text fields of a row by slot."""
    return F.array(*[F.coalesce(F.col(f), F.lit("")) for f in TEXT_FIELDS])


def matches(c: Column, texts: Column) -> Column:
    """Evaluate a prepared condition on the current row."""
    slot, op, value, number = c["slot"], c["op"], c["value"], c["number"]
    d, x, text = F.col("date"), F.col("amount"), F.get(texts, slot)
    is_ = lambda name: op == _code(name)
    on_text = (
        F.when(is_("equals"), text == value)
        .when(is_("oneOf"), F.array_contains(c["values"], text))
        .when(is_("startsWith"), F.startswith(text, value))
        .when(is_("contains"), F.contains(text, value))
        .when(is_("endsWith"), F.endswith(text, value))
        .when(is_("notEquals"), text != value)
        .when(is_("notContains"), ~F.contains(text, value))
        .when(is_("matches"), F.regexp_like(text, value))
    )
    on_amount = (
        F.when(is_("equals"), x == number)
        .when(is_("notEquals"), x != number)
        .when(is_("greaterThan"), x > number)
        .when(is_("lessThan"), x < number)
        .when(is_("greaterThanOrEqual"), x >= number)
        .when(is_("lessThanOrEqual"), x <= number)
        .when(is_("between"), x.between(c["lo"], c["hi"]))
    )
    on_date = (
        F.when(is_("firstDayOfMonth"), F.dayofmonth(d) == 1)
        .when(is_("firstMondayOfMonth"), dates.is_first_weekday(d, 0))
        .when(is_("firstSaturdayOfMonth"), dates.is_first_weekday(d, 5))
        .when(is_("firstSundayOfMonth"), dates.is_first_weekday(d, 6))
        .when(is_("lastDayOfMonth"), d == F.last_day(d))
        .when(is_("lastMondayOfMonth"), dates.is_last_weekday(d, 0))
        .when(is_("lastSaturdayOfMonth"), dates.is_last_weekday(d, 5))
        .when(is_("lastSundayOfMonth"), dates.is_last_weekday(d, 6))
        .when(is_("specificDay"), F.dayofmonth(d) == number)
        .when(is_("dayRange"), F.dayofmonth(d).between(c["lo"], c["hi"]))
    )
    flag = F.when(slot == -3, F.col("is_bank_commission")).otherwise(F.col("is_cashback"))
    result = (
        F.when(slot >= 0, on_text)
        .when(slot == -2, on_amount & (F.col("currency") == c["currency"]))
        .when(slot == -1, on_date)
        .otherwise(flag.eqNullSafe(is_("isTrue")))
    )
    return F.coalesce(result, F.lit(False))


def signature(conditions: Column) -> Column:
    """Order-free text form of a condition list (a multiset)."""

    def one(c: Column) -> Column:
        part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), v.cast("string")))
        return F.concat_ws(
            "|",
            c["field"],
            c["operator"],
            F.concat_ws(
                ",",
                part("currency", c["currency"]),
                part("hi", c["hi"]),
                part("lo", c["lo"]),
                part("value", c["value"]),
                F.when(F.size(c["values"]) > 0, F.concat(F.lit("values="), F.array_join(c["values"], ";"))),
            ),
        )

    return F.array_join(F.array_sort(F.transform(conditions, one)), "\n")


def ordered_signature(conditions: Column) -> Column:
    """Content text that keeps the order of the conditions."""
    return F.to_json(conditions)
