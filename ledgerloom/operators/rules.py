"""First-match rule evaluation, rule tables and rule-set changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.conditions import (
    Rule,
    compile_condition,
    compile_conditions,
    condition_problem,
    matches,
    nests_quantifiers,
    ordered_signature,
    prepared,
    row_texts,
    signature,
)
from ledgerloom.session import materialize

# Rules per CASE expression; longer lists are chained so that generated
# methods stay below the JVM's size limit.
CHUNK = 100


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (r.order, r.rule_id))


def first_match(rules: Sequence[Rule], pick=lambda r: r.rule_id) -> Column:
    """``pick`` of the first rule that accepts the row, else null."""
    # The value is wrapped, so that a winner with a null value ends the search too.
    chunks: list[Column] = []
    todo = ordered(rules)
    for i in range(0, len(todo), CHUNK):
        case = None
        for rule in todo[i : i + CHUNK]:
            test, value = compile_conditions(rule.conditions), F.struct(F.lit(pick(rule)).alias("v"))
            case = F.when(test, value) if case is None else case.when(test, value)
        chunks.append(case)
    return F.coalesce(*chunks)["v"] if chunks else F.lit(None)


def with_rule(txns: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the winning ``rule_id`` and its category as ``rule_category``.

    The CASE chain is evaluated once; the category follows from the id.
    """
    categories = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.category_id)])
    return txns.withColumn("rule_id", first_match(rules).cast("long")).withColumn(
        "rule_category", F.try_element_at(categories, F.col("rule_id").cast("int"))
    )


# What a rule can be filed under, most selective first: a demanded text, the
# first or last three characters of one, or three characters inside one.
GRAM = 3
ANCHORS = (
    ("exact", "description"), ("exact", "counterparty"), ("exact", "mcc"),
    ("head", "description"), ("head", "counterparty"), ("tail", "description"), ("tail", "counterparty"),
    ("exact", "account"), ("head", "account"), ("tail", "account"), ("exact", "bank_category"), ("exact", "currency"),
    ("gram", "description"), ("gram", "counterparty"), ("gram", "account"),
)
#: Under no text at all.
ANY = ("any", "")
#: Rules that a row meets at once under one anchor; further ones are met in chunks of as many.
CHUNK_RULES = 500


def _judged(rules: DataFrame) -> DataFrame:
    problems = F.filter(
        F.transform("conditions", lambda c, i: F.struct(condition_problem(c).alias("reason"), i.alias("condition"))),
        lambda p: p["reason"].isNotNull(),
    )
    return rules.withColumn("_problems", problems)


def rule_errors(rules: DataFrame) -> DataFrame:
    """``(ruleset_id, rule_id, condition, reason)`` of conditions outside the grammar."""
    return (
        _judged(rules)
        .select("ruleset_id", "rule_id", F.explode("_problems").alias("p"))
        .select("ruleset_id", "rule_id", "p.condition", "p.reason")
    )


def valid_rules(rules: DataFrame) -> DataFrame:
    """The rules without errors; one tenant's faulty rule touches nobody else's.

    A rule without a condition list matches every row, like an empty list.
    """
    good = F.size(F.coalesce("_problems", F.array().cast("array<struct<reason:string,condition:int>>"))) == 0
    return _judged(rules).where(good).drop("_problems")


def reachable_rules(rules: DataFrame) -> DataFrame:
    """The rules that can win a first match.

    A rule never wins behind another one of its set with the same conditions, in
    any order, or behind one that accepts every row. Sets with a rule that has
    no place (no order or no id) are left whole.
    """
    place = F.struct("order", "rule_id")
    unplaced = F.col("order").isNull() | F.col("rule_id").isNull()
    free = F.coalesce(F.size("conditions"), F.lit(0)) <= 0
    ends = rules.groupBy("ruleset_id").agg(F.min(F.when(free, place)).alias("_end"), F.bool_or(unplaced).alias("_unplaced"))
    kept = rules.join(ends, "ruleset_id").where(F.col("_unplaced") | F.col("_end").isNull() | (place <= F.col("_end")))
    demand = F.array_sort(F.array_distinct(F.coalesce("conditions", F.array().cast(rules.schema["conditions"].dataType))))
    best = F.struct("order", "rule_id", "category_id")
    columns = ("ruleset_id", "rule_id", "order", "category_id", "conditions")
    first = (
        kept.where(~F.col("_unplaced"))
        .groupBy("ruleset_id", demand.alias("_demand"))
        .agg(F.min(best).alias("_best"), F.min_by("conditions", best).alias("conditions"))
        .select("ruleset_id", "_best.*", "conditions")
        .select(*columns)
    )
    return first.unionByName(kept.where("_unplaced").select(*columns))


def _grams(text: Column) -> Column:
    """All stretches of three characters of a text."""
    n = F.char_length(text) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(GRAM)))))


def _demands(c: Column) -> Column:
    """What a condition demands of a text: ``struct<rank, kind, field, texts>``, or null."""
    op, long = c["operator"], F.char_length(c["value"]) >= GRAM
    kind = (
        F.when(op.isin("equals", "oneOf"), "exact")
        .when((op == "startsWith") & long, "head")
        .when((op == "endsWith") & long, "tail")
        .when((op == "contains") & long, "gram")
    )
    texts = (
        F.when(op == "oneOf", F.array_distinct(F.array_compact(c["values"])))
        .when(kind == "exact", F.array(c["value"]))
        .when(kind == "head", F.array(F.substring(c["value"], F.lit(1), F.lit(GRAM))))
        .when(kind == "tail", F.array(F.substring(c["value"], F.char_length(c["value"]) - (GRAM - 1), F.lit(GRAM))))
        .otherwise(_grams(c["value"]))
    )
    ranks = F.create_map(*[F.lit(x) for i, (k, f) in enumerate(ANCHORS) for x in (f"{k} {f}", i)])
    rank = F.try_element_at(ranks, F.concat_ws(" ", kind, c["field"]))
    found = F.struct(rank.alias("rank"), kind.alias("kind"), c["field"].alias("field"), texts.alias("texts"))
    return F.when(kind.isNotNull() & rank.isNotNull(), found)


def rule_index(rules: DataFrame) -> DataFrame:
    """The rules under the texts they demand: ``(ruleset_id, kind, field, text, chunk, rules)``.

    A rule is filed under its most selective demand (``ANCHORS``); of the
    stretches inside a demanded text it is the one that the fewest rules of its
    set share. A row can only be accepted by rules filed under its own texts.
    One row holds at most ``CHUNK_RULES`` rules, in order.
    """
    best = F.array_min(F.array_compact(F.transform("conditions", _demands)))
    item = F.struct("order", "rule_id", "category_id", F.transform("conditions", prepared).alias("conditions"))
    filed = rules.select("ruleset_id", item.alias("rule"), best.alias("best")).select(
        "ruleset_id",
        "rule",
        F.coalesce("best.kind", F.lit(ANY[0])).alias("kind"),
        F.coalesce("best.field", F.lit(ANY[1])).alias("field"),
        F.explode(F.when(F.col("best").isNull(), F.array(F.lit(""))).otherwise(F.col("best.texts"))).alias("text"),
    )
    shared = F.count(F.lit(1)).over(W.partitionBy("ruleset_id", "kind", "field", "text"))
    rarest = W.partitionBy("ruleset_id", "rule.rule_id").orderBy("_shared", "text")
    grams = filed.where("kind = 'gram'").withColumn("_shared", shared).withColumn("_n", F.row_number().over(rarest)).where("_n = 1")
    filed = filed.where("kind <> 'gram'").unionByName(grams.drop("_shared", "_n"))
    key = ("ruleset_id", "kind", "field", "text")
    place = F.row_number().over(W.partitionBy(*key).orderBy("rule.order", "rule.rule_id")) - 1
    return (
        filed.withColumn("chunk", F.floor(place / CHUNK_RULES))
        .groupBy(*key, "chunk")
        .agg(F.array_sort(F.collect_list("rule")).alias("rules"))
    )


def _own_text(kind: str, field: str) -> Column:
    """The text of a row that rules of a kind are filed under."""
    text = F.coalesce(F.col(field), F.lit("")) if field else F.lit("")
    if kind == "head":
        return F.substring(text, F.lit(1), F.lit(GRAM))
    if kind == "tail":
        return F.substring(text, F.greatest(F.lit(1), F.char_length(text) - (GRAM - 1)), F.lit(GRAM))
    return text


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_FOUND = "struct<order:bigint,rule_id:bigint,category_id:string>"


def _first_of(candidates: Column, found: Column | None = None) -> Column:
    """The first of the candidate rules that accepts the row; ``found`` is an earlier find to beat."""

    def better(texts: Column, best: Column, r: Column) -> Column:
        """The earlier rule by order, then id; one behind the best so far is not evaluated."""
        accepts = F.coalesce(F.forall(r["conditions"], lambda c: matches(c, texts)), F.lit(True))
        hit = F.struct(r["order"].alias("order"), r["rule_id"].alias("rule_id"), r["category_id"].alias("category_id"))
        behind = (best["order"] < r["order"]) | ((best["order"] == r["order"]) & (best["rule_id"] <= r["rule_id"]))
        return F.when(behind, best).when(accepts, hit.cast(_FOUND)).otherwise(best)

    none = F.struct(F.lit(None).alias("order"), F.lit(None).alias("rule_id"), F.lit(None).alias("category_id")).cast(_FOUND)
    start = none if found is None else found
    return _let(row_texts(), lambda texts: F.aggregate(candidates, start, lambda best, r: better(texts, best, r)))


def with_rule_by_set(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """First match where every row belongs to one of many rule sets.

    Rows meet the rules filed under their own texts by equi-joins on the rule
    set and the text, one for each kind of anchor that the rules use; no rule
    set is held in a row, and rows are not multiplied. What is filed under a
    stretch inside a text, and what a crowded anchor holds beyond its first
    chunk, is met in a second pass over one row per such stretch or chunk, whose
    earliest accepted rule comes back by row. Rules with an error
    (``rule_errors``) are left out, and so are those that never win.
    """
    index = materialize(rule_index(reachable_rules(valid_rules(rules))), "rule-index")
    deep = (F.col("kind") == "gram") | (F.col("chunk") > 0)
    used = index.select("kind", "field", deep.alias("deep")).distinct().collect()  # as many as there are kinds of anchors
    rows = txns
    if any(u.deep for u in used):
        rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "rule-rows")
    joined, lists = rows, []
    for n, (kind, field) in enumerate(sorted({(u.kind, u.field) for u in used if not u.deep})):
        met = index.where((F.col("kind") == kind) & (F.col("field") == field) & ~deep)
        met = met.select(F.col("ruleset_id").alias(f"_set{n}"), F.col("text").alias(f"_text{n}"), F.col("rules").alias(f"_rules{n}"))
        on = (F.col("ruleset_id") == F.col(f"_set{n}")) & (_own_text(kind, field) == F.col(f"_text{n}"))
        joined = joined.join(met, on, "left").drop(f"_set{n}", f"_text{n}")
        lists.append(f"_rules{n}")
    none = F.array().cast(index.schema["rules"].dataType)
    candidates = F.flatten(F.array_compact(F.array(*lists))) if lists else none
    hit = joined.withColumn("_hit", _first_of(candidates)).drop(*lists)
    if any(u.deep for u in used):
        hit = _deeper(hit, rows, index.where(deep), [(u.kind, u.field) for u in used if u.deep])
    return (
        hit.withColumn("rule_id", F.col("_hit.rule_id"))
        .withColumn("rule_category", F.col("_hit.category_id"))
        .drop("_hit", "_id")
    )


def _filed_as(kind: str, field: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), t.alias("text"))


def _deeper(hit: DataFrame, rows: DataFrame, index: DataFrame, used: list[tuple[str, str]]) -> DataFrame:
    """The finds of ``hit`` or earlier ones among rules that are met by stretch or by chunk."""
    anchors = []
    for kind, field in used:
        own = _own_text(kind, field)
        texts = F.coalesce(_grams(own), F.array().cast("array<string>")) if kind == "gram" else F.array(own)
        anchors.append(F.transform(texts, _filed_as(kind, field)))
    sets = index.select("ruleset_id").distinct()
    spread = rows.join(sets, "ruleset_id", "left_semi").withColumn("_a", F.explode(F.concat(*anchors)))
    spread = spread.select("*", "_a.kind", "_a.field", "_a.text").drop("_a")
    met = spread.join(index, ["ruleset_id", "kind", "field", "text"])
    found = met.select("_id", _first_of(F.col("rules")).alias("_deep")).where("_deep.rule_id is not null")
    found = found.groupBy("_id").agg(F.min("_deep").alias("_deep"))
    best = F.array_min(F.array_compact(F.array(F.when(F.col("_hit.rule_id").isNotNull(), F.col("_hit")), F.col("_deep"))))
    return hit.join(found, "_id", "left").withColumn("_hit", best).drop("_deep")


def live_rules(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules whose category exists."""
    return rules.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")


def applied_counts(txns: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows won per rule, zero for rules that never win."""
    spark = txns.sparkSession
    dimension = spark.createDataFrame(
        [(r.rule_id, r.order, r.category_id) for r in ordered(rules)], "rule_id long, position long, category_id string"
    )
    won = with_rule(txns, rules).where("rule_id is not null").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("applied")
    )
    return dimension.join(won, "rule_id", "left").select(
        "rule_id", "position", "category_id", F.coalesce("applied", F.lit(0)).alias("applied_count")
    )


def applied_counts_by_set(txns: DataFrame, rules: DataFrame) -> DataFrame:
    won = with_rule_by_set(txns, rules).where("rule_id is not null").groupBy("ruleset_id", "rule_id").agg(
        F.count(F.lit(1)).alias("applied")
    )
    return rules.join(won, ["ruleset_id", "rule_id"], "left").select(
        "ruleset_id", "rule_id", F.coalesce("applied", F.lit(0)).alias("applied_count")
    )


# ------------------------------------------------------------- rule tables


def next_order(rules: DataFrame) -> DataFrame:
    return rules.groupBy("ruleset_id").agg((F.max("order") + 1).alias("next_order"))


def unsafe_patterns(rules: DataFrame) -> DataFrame:
    """``matches`` conditions whose pattern nests quantifiers."""
    conditions = rules.select("ruleset_id", "rule_id", F.explode("conditions").alias("c")).where(
        "c.operator = 'matches'"
    )
    return conditions.select(
        "ruleset_id", "rule_id", F.col("c.value").alias("pattern"), nests_quantifiers(F.col("c.value")).alias("unsafe")
    )


def condition_signatures(rules: DataFrame) -> DataFrame:
    return rules.select("ruleset_id", "rule_id", signature(F.col("conditions")).alias("signature"))


def _content(rules: DataFrame) -> DataFrame:
    """Rules numbered among the equal ones of their set."""
    keyed = rules.withColumn("_content", F.concat_ws("\n", "category_id", ordered_signature(F.col("conditions"))))
    nth = W.partitionBy("ruleset_id", "_content").orderBy("order", "rule_id")
    return keyed.withColumn("_nth", F.row_number().over(nth))


def rule_set_diff(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Changes that turn the stored rules into the wanted ones.

    Equal content (category and ordered conditions) keeps its stored id and
    takes the new order; the rest is inserted or deleted.
    """
    old = _content(stored).select(
        "ruleset_id", "_content", "_nth", F.col("rule_id").alias("old_id"), F.col("order").alias("old_order")
    )
    new = _content(wanted).select(
        "ruleset_id", "_content", "_nth", F.col("order").alias("new_order"), F.col("category_id").alias("new_category")
    )
    both = old.join(new, ["ruleset_id", "_content", "_nth"], "full_outer")
    op = (
        F.when(F.col("old_id").isNull(), F.lit("insert"))
        .when(F.col("new_order").isNull(), F.lit("delete"))
        .otherwise(F.lit("update"))
    )
    return both.select("ruleset_id", op.alias("op"), "old_id", "old_order", "new_order")


def reorder_subset(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Give the listed rules their own order slots in the listed sequence.

    ``wanted(ruleset_id, rule_id, position)``; the slots are sorted and dealt
    out by position, other rules stay where they are.
    """
    listed = rules.join(wanted, ["ruleset_id", "rule_id"]).select("ruleset_id", "rule_id", "order", "position")
    by_slot = W.partitionBy("ruleset_id").orderBy("order")
    by_position = W.partitionBy("ruleset_id").orderBy("position")
    slots = listed.select("ruleset_id", F.row_number().over(by_slot).alias("_n"), F.col("order").alias("_slot"))
    turns = listed.select("ruleset_id", F.row_number().over(by_position).alias("_n"), "rule_id")
    dealt = turns.join(slots, ["ruleset_id", "_n"]).select("ruleset_id", "rule_id", "_slot")
    return rules.join(dealt, ["ruleset_id", "rule_id"], "left").withColumn(
        "order", F.coalesce("_slot", "order")
    ).drop("_slot")


def reorder_preview(rules: DataFrame, ranks: DataFrame) -> DataFrame:
    """Ranked rules first, the others after them in their old sequence."""
    seq = W.partitionBy("ruleset_id").orderBy(F.col("rank").asc_nulls_last(), "order", "rule_id")
    return (
        rules.join(ranks, ["ruleset_id", "rule_id"], "left")
        .withColumn("order", (F.row_number().over(seq) - 1).cast("long"))
        .drop("rank")
    )


def classify_edits(edits: DataFrame) -> DataFrame:
    """Lane of an edit: ``live`` at once or ``sandbox`` first.

    ``edits(kind, before, after, ...)`` with condition lists for edits of
    conditions; re-saving the same set of conditions changes nothing.
    """
    same = signature(F.col("before")).eqNullSafe(signature(F.col("after")))
    lane = (
        F.when(F.col("kind").isin("reorder", "delete"), "sandbox")
        .when(F.col("kind").isin("categoryOnly", "appendEnd"), "live")
        .when(F.col("kind") == "editConditions", F.when(same, "live").otherwise("sandbox"))
    )
    return edits.withColumn("lane", lane)


def apply_edits(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Rule sets after one edit per rule.

    ``edits(ruleset_id, rule_id, kind, category_id, after, rank)``; deletes
    drop the rule, category and condition edits replace fields, appends go
    behind the last rule, and ranks move rules to the front.
    """
    change = edits.select(
        "ruleset_id",
        "rule_id",
        "kind",
        F.col("category_id").alias("_category"),
        F.col("after").alias("_after"),
        "rank",
    )
    kept = (
        rules.join(change.where("kind <> 'appendEnd'"), ["ruleset_id", "rule_id"], "left")
        .where("kind is null or kind <> 'delete'")
        .select(
            "ruleset_id",
            "rule_id",
            F.col("order"),
            F.when(F.col("kind") == "categoryOnly", F.col("_category")).otherwise(F.col("category_id")).alias("category_id"),
            F.when(F.col("kind") == "editConditions", F.col("_after")).otherwise(F.col("conditions")).alias("conditions"),
            F.when(F.col("kind") == "reorder", F.col("rank")).alias("rank"),
            F.lit(0).alias("_tail"),
        )
    )
    appended = change.where("kind = 'appendEnd'").select(
        "ruleset_id",
        "rule_id",
        F.lit(None).cast("long").alias("order"),
        F.col("_category").alias("category_id"),
        F.col("_after").alias("conditions"),
        F.lit(None).cast("long").alias("rank"),
        F.lit(1).alias("_tail"),
    )
    seq = W.partitionBy("ruleset_id").orderBy(
        "_tail", F.col("rank").asc_nulls_last(), F.col("order").asc_nulls_last(), "rule_id"
    )
    return (
        kept.unionByName(appended)
        .withColumn("order", (F.row_number().over(seq) - 1).cast("long"))
        .select("ruleset_id", "rule_id", "order", "category_id", "conditions")
    )


# ------------------------------------------------------------------ explain


def with_trace(txns: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What first-match evaluation looked at, as an array of rule results.

    ``status`` is win, miss, or neutral for the rules behind the winner.
    ``met`` holds one flag per condition; null where the evaluation stopped
    before the condition. The winner is found first, so every condition
    appears a fixed number of times in the plan.
    """
    todo = ordered(rules)
    place = {r.rule_id: i for i, r in enumerate(todo)}
    won = F.col("_won")
    out: list[Column] = []
    for i, rule in enumerate(todo):
        going = won >= i
        flags: list[Column] = []
        for c in rule.conditions:
            test = compile_condition(c)
            flags.append(F.when(going, test))
            going = going & test
        out.append(
            F.struct(
                F.lit(rule.rule_id).cast("long").alias("rule_id"),
                F.lit(rule.category_id).alias("category_id"),
                F.when(won == i, "win").when(won > i, "miss").otherwise("neutral").alias("status"),
                (F.array(*flags) if flags else F.array().cast("array<boolean>")).alias("met"),
            )
        )
    winner = F.coalesce(first_match(todo, lambda r: place[r.rule_id]), F.lit(len(todo)))
    return txns.withColumn("_won", winner).withColumn("trace", F.array(*out)).drop("_won")


def condition_dictionary(rules: DataFrame) -> DataFrame:
    """One row per rule set: its different conditions, and its rules as places among them.

    ``_conditions`` holds each different condition once, prepared; ``_rules`` the
    rules in order, each with the places of its conditions (``at``). Rules with
    an error (``rule_errors``) are left out.
    """
    good = valid_rules(rules).select("ruleset_id", "rule_id", "order", "category_id", "conditions")
    long = good.select("ruleset_id", "rule_id", F.posexplode("conditions").alias("_i", "_c")).withColumn("_text", F.to_json("_c"))
    number = F.row_number().over(W.partitionBy("ruleset_id").orderBy("_text")) - 1
    different = long.groupBy("ruleset_id", "_text").agg(F.first("_c").alias("_c")).withColumn("_at", number)
    listed = different.groupBy("ruleset_id").agg(F.array_sort(F.collect_list(F.struct("_at", prepared(F.col("_c")).alias("c")))).alias("_c"))
    listed = listed.select("ruleset_id", F.transform("_c", lambda x: x["c"]).alias("_conditions"))
    places = (
        long.join(different.select("ruleset_id", "_text", "_at"), ["ruleset_id", "_text"])
        .groupBy("ruleset_id", "rule_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_at"))), lambda x: x["_at"]).alias("at"))
    )
    at = F.coalesce("at", F.array().cast("array<int>")).alias("at")
    sets = (
        good.join(places, ["ruleset_id", "rule_id"], "left")
        .groupBy("ruleset_id")
        .agg(F.array_sort(F.collect_list(F.struct("order", "rule_id", "category_id", at))).alias("_rules"))
    )
    return sets.join(listed, "ruleset_id", "left")


def with_trace_by_set(txns: DataFrame, rules: DataFrame, shown: Sequence[Column] | None = None) -> DataFrame:
    """``with_trace`` where every row belongs to one of many rule sets.

    Each different condition of the row's set is evaluated once for the row; which
    rules accept the row, and what the trace shows of them, follows from these bits
    alone, so it is worked out once per rule set and different bits, and comes back
    to the rows by an equi-join. A row without a rule set has an empty trace.

    ``shown`` names expressions over ``trace`` that are added in its place; they
    too are worked out once per different bits, and the trace itself is not moved.
    """
    known = materialize(condition_dictionary(rules), "conditions")
    joined = txns.join(known.select("ruleset_id", "_conditions"), "ruleset_id", "left")

    def result(r: Column, i: Column, won: Column, bits: Column) -> Column:
        flags = F.transform(r["at"], lambda k: F.get(bits, k))
        stop = F.array_position(flags, F.lit(False))  # evaluation ends with the first condition that is not met
        met = _let(stop, lambda stop: F.transform(flags, lambda b, j: F.when((i <= won) & ((stop == 0) | (j < stop)), b)))
        status = F.when(won == i, "win").when(won > i, "miss").otherwise("neutral")
        return F.struct(r["rule_id"].alias("rule_id"), r["category_id"].alias("category_id"), status.alias("status"), met.alias("met"))

    def traced(bits: Column) -> Column:
        accepts = F.transform("_rules", lambda r: F.forall(r["at"], lambda k: F.get(bits, k)))
        at = F.array_position(accepts, F.lit(True)) - 1
        return _let(at, lambda at: _let(F.when(at >= 0, at).otherwise(F.size("_rules")), lambda won: F.transform("_rules", lambda r, i: result(r, i, won, bits))))

    conditions = F.coalesce("_conditions", F.array().cast(joined.schema["_conditions"].dataType))
    bits = _let(row_texts(), lambda texts: F.transform(conditions, lambda c: matches(c, texts)))
    judged = joined.withColumn("_bits", bits).drop("_conditions")
    # few bytes but much work each: dealt out to all cores
    decisions = judged.select("ruleset_id", "_bits").distinct().repartition(txns.sparkSession.sparkContext.defaultParallelism)
    decisions = decisions.join(known.select("ruleset_id", "_rules"), "ruleset_id", "left")
    trace = F.coalesce(traced(F.col("_bits")).cast(_TRACE), F.array().cast(_TRACE))
    told = decisions.withColumn("trace", trace).select(
        F.col("ruleset_id").alias("_set"), F.col("_bits").alias("_same"), *(["trace"] if shown is None else shown)
    )
    told = materialize(told, "traces")
    on = F.col("ruleset_id").eqNullSafe(F.col("_set")) & (F.col("_bits") == F.col("_same"))
    return judged.join(told, on, "left").drop("_set", "_same", "_bits")


_TRACE = "array<struct<rule_id:bigint,category_id:string,status:string,met:array<boolean>>>"


def why(
    txns: DataFrame, rules: Sequence[Rule] | DataFrame, manual: Column, shown: Sequence[Column] | None = None
) -> DataFrame:
    """The trace with manual decisions on top: they leave no rule winner.

    ``rules`` is a literal list, or a table of rule sets for rows with a ``ruleset_id``.
    ``shown`` names expressions over ``trace`` that are added in its place.
    """
    wanted = [F.col("trace")] if shown is None else list(shown)
    winner = F.try_element_at(F.filter("trace", lambda r: r["status"] == "win"), F.lit(1))["rule_id"].alias("_winner")
    if isinstance(rules, DataFrame):
        traced = with_trace_by_set(txns, rules, [*wanted, winner])
    else:
        traced = with_trace(txns, rules).select(*txns.columns, *wanted, winner)
    traced = traced.withColumn("manual_category", manual)
    return traced.withColumn("winner_rule_id", F.when(F.col("manual_category").isNull(), F.col("_winner"))).drop("_winner")
