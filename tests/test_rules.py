import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules as ops
from ledgerloom.operators.conditions import Condition, Rule

CONDITION = "struct<field:string,operator:string,value:string,values:array<string>,lo:double,hi:double,currency:string>"
RULES = f"ruleset_id string, rule_id long, order long, category_id string, conditions array<{CONDITION}>"
TXN = (
    "ruleset_id string, id long, date date, amount double, currency string, description string, counterparty string, "
    "account string, bank_category string, mcc string, is_bank_commission boolean, is_cashback boolean"
)


def txns(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        ("a", 1, day, 10.0, "UAH", "shop one", "c", None, "food", "5411", False, False),
        ("a", 2, day, 20.0, "USD", "cafe", None, None, None, None, None, True),
        ("b", 3, day, 10.0, "UAH", "x" * 5_000 + " end", None, None, "food", "5411", False, False),
    ]
    return spark.createDataFrame(rows, TXN)


def condition(field, operator, value=None, values=None, lo=None, hi=None, currency=None):
    return (field, operator, value, values, lo, hi, currency)


def winners(spark, rows):
    rules = spark.createDataFrame(rows, RULES)
    return {r["id"]: r["rule_id"] for r in ops.with_rule_by_set(txns(spark), rules).collect()}


def test_equal_orders_go_to_the_smaller_id(spark):
    broad, fine = condition("description", "contains", "shop"), condition("description", "equals", "shop one")
    assert winners(spark, [("a", 2, 0, "x", [fine]), ("a", 1, 0, "y", [broad])])[1] == 1
    literal = [Rule(2, 0, "x", (Condition("description", "equals", "shop one"),)), Rule(1, 0, "y", (Condition("description", "contains", "shop"),))]
    assert ops.with_rule(txns(spark), literal).where("id = 1").first()["rule_id"] == 1


def test_faulty_rules_are_reported_and_touch_nobody(spark):
    faulty = [
        [condition("nope", "isFalse")],
        [condition("mcc", "contains", "5")],
        [condition("amount", "equals", "10", currency=" ")],
        [condition("amount", "between", lo=1.0, currency="UAH")],
        [condition("amount", "equals", "ten", currency="UAH")],
        [condition("description", "equals")],
        [condition("mcc", "oneOf")],
        [condition("description", "matches", "(")],
        [condition("description", "matches", "(a+)+$")],
        [condition(None, None)],
    ]
    rows = [("a", i, i, "f", c) for i, c in enumerate(faulty)]
    rows += [("a", 50, 90, "x", [condition("mcc", "oneOf", values=[None, "5411"])]), ("a", 51, 91, "y", None), ("b", 60, 0, "z", [])]
    errors = ops.rule_errors(spark.createDataFrame(rows, RULES)).orderBy("rule_id").collect()
    assert [(e["rule_id"], e["reason"]) for e in errors] == list(
        enumerate(
            ["unknown-field", "unsupported-operator", "amount-without-currency", "missing-value", "missing-value",
             "missing-value", "missing-value", "invalid-pattern", "unsafe-pattern", "unknown-field"]
        )
    )
    assert winners(spark, rows) == {1: 50, 2: 51, 3: 60}


def test_patterns_see_the_whole_text(spark):
    assert winners(spark, [("b", 1, 0, "x", [condition("description", "matches", "end$")])])[3] == 1
    literal = [Rule(1, 0, "x", (Condition("description", "matches", "end$"),))]
    assert ops.with_rule(txns(spark), literal).where("id = 3").first()["rule_id"] == 1


def test_a_winner_with_a_null_value_ends_the_search(spark, monkeypatch):
    monkeypatch.setattr(ops, "CHUNK", 1)
    rules = [Rule(1, 0, "x", ()), Rule(2, 1, "y", ())]
    picked = ops.first_match(rules, lambda r: None if r.rule_id == 1 else "later")
    assert {r["p"] for r in txns(spark).select(picked.alias("p")).collect()} == {None}


def random_rules(rng, n):
    """Rules of every kind of anchor, as rows and as literal rules."""
    words = ["shop", "one", "cafe", "food", "end", "x", "sho", "ne", "", "shop one", "54"]
    rows, literal = [], []
    for i in range(n):
        found = []
        for _ in range(rng.randrange(4)):
            field, op = rng.choice(
                [(f, o) for f in ("description", "counterparty", "account") for o in ("equals", "contains", "startsWith", "endsWith", "notContains")]
                + [("mcc", "oneOf"), ("bank_category", "equals"), ("currency", "equals"), ("is_cashback", "isTrue"), ("amount", "greaterThan")]
            )
            value = rng.choice(words) if field not in ("amount", "mcc") else "15" if field == "amount" else None
            values = [rng.choice(["5411", "5814", ""]), "1"] if op == "oneOf" else None
            found.append((field, op, None if op == "isTrue" else value, values, None, None, "UAH" if field == "amount" else None))
        order = rng.randrange(n)
        rows.append(("a", i, order, "c", found))
        literal.append(Rule(i, order, "c", tuple(Condition(f, o, v, tuple(vs or ()), currency=c) for f, o, v, vs, _, _, c in found)))
    return rows, literal


@pytest.mark.parametrize(("seed", "chunk"), [(1, 500), (2, 1), (3, 2)])
def test_rules_under_every_anchor_equal_literal_rules(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(ops, "CHUNK_RULES", chunk)
    rng = random.Random(seed)
    rows, literal = random_rules(rng, 40)
    literal, rows = literal[: 40 - 5 * seed], rows[: 40 - 5 * seed]
    text = lambda: rng.choice([None, "", "shop", "shop one", "a shop", "cafe end", "xx one x", "no", "ne"])
    made = [
        ("a", i, dt.date(2024, 1, 1), float(rng.randrange(30)), rng.choice(["UAH", "USD"]), text(), text(), text(), text(), rng.choice(["5411", "5814", None]), False, rng.random() < 0.3)
        for i in range(80)
    ]
    frame = spark.createDataFrame([*made, ("other", 99, None, None, None, None, None, None, None, None, None, None)], TXN)
    got = {r["id"]: r["rule_id"] for r in ops.with_rule_by_set(frame, spark.createDataFrame(rows, RULES)).collect()}
    want = {r["id"]: r["rule_id"] for r in ops.with_rule(frame.where("id < 99"), literal).collect()}
    assert got == {**want, 99: None}


def test_no_rule_set_travels_in_a_row(spark):
    """A row meets the few rules under its own texts, however many its set has."""
    rows = [("a", i, i, "c", [condition("description", "startsWith", f"w{i} shop")]) for i in range(400)]
    rows += [("a", 900, 900, "c", [condition("description", "contains", "hop o")])]
    index = ops.rule_index(spark.createDataFrame(rows, RULES)).collect()
    assert max(len(r["rules"]) for r in index) <= 111 and {r["kind"] for r in index} == {"head", "gram"}
    assert winners(spark, rows)[1] == 900


def test_rules_that_never_win_are_not_met(spark):
    """A rule behind one that accepts every row, or behind the same conditions, can never win."""
    shop, mcc = condition("description", "contains", "shop"), condition("mcc", "equals", "5411")
    rows = [("a", i, 0, "c", [shop, mcc] if i % 2 else [mcc, shop]) for i in range(300)]
    rows += [("a", 400, 0, "all", None), ("a", 300, 0, "c", [condition("account", "equals", "k")])]
    rows += [("a", i, 1, "late", [condition("description", "matches", f"{i}$")]) for i in range(500, 900)]
    rows += [("b", i, 0, "c", [mcc]) for i in (7, 6)] + [("b", None, 0, "c", [mcc])]
    found = ops.reachable_rules(spark.createDataFrame(rows, RULES)).collect()
    assert {r["rule_id"] for r in found if r["ruleset_id"] == "a"} == {0, 300, 400}
    assert sum(r["ruleset_id"] == "b" for r in found) == 3  # a rule without an id leaves its set whole
    assert winners(spark, rows[:-1]) == {1: 0, 2: 400, 3: 6}
    index = ops.rule_index(ops.reachable_rules(spark.createDataFrame(rows[:-1], RULES)))
    assert sum(len(r["rules"]) for r in index.collect()) == 4


def test_traces_are_worked_out_once_per_rule_set_and_met_conditions(spark, monkeypatch):
    stored = {}
    plain = ops.materialize
    monkeypatch.setattr(ops, "materialize", lambda df, name: stored.setdefault(name, plain(df, name)))
    shop, mcc = condition("description", "contains", "shop"), condition("mcc", "equals", "5411")
    rows = [("a", 1, 0, "x", [shop, mcc]), ("a", 2, 1, "y", [mcc]), ("b", 3, 0, "z", [])]
    one = ("shop", "cafe", None)
    made = [(s, i, None, float(i), "UAH", f"{one[i % 3]} {i}" if one[i % 3] else None, None, None, None, "5411", False, False) for i, s in enumerate(["a", "b", "none", None] * 30)]
    frame = spark.createDataFrame(made, TXN)
    literal = [Rule(1, 0, "x", (Condition("description", "contains", "shop"), Condition("mcc", "equals", "5411"))), Rule(2, 1, "y", (Condition("mcc", "equals", "5411"),))]
    want = {r["id"]: r["trace"] for r in ops.with_trace(frame.where("ruleset_id = 'a'"), literal).collect()}
    rules = spark.createDataFrame(rows, RULES)
    told = ops.why(frame, rules, F.when(F.col("id") == 0, "m"), [F.size("trace").alias("n"), F.to_json("trace").alias("text")])
    assert told.columns == [*frame.columns, "n", "text", "manual_category", "winner_rule_id"]
    got = {r["id"]: r for r in told.collect()}
    assert len(got) == 120 and stored["traces"].count() == 5  # two in a, one in b and each kind of row without a set
    assert {s: {got[i]["n"] for i in got if got[i]["ruleset_id"] == s} for s in ("a", "b", "none", None)} == {"a": {2}, "b": {1}, "none": {0}, None: {0}}
    assert [got[i]["winner_rule_id"] for i in (0, 4, 12, 1, 2)] == [None, 2, 1, 3, None]
    stored.clear()
    traced = {r["id"]: r["trace"] for r in ops.with_trace_by_set(frame, rules).collect()}
    assert {i: traced[i] for i in want} == want and traced[2] == traced[3] == []
