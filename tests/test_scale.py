"""Work that must not grow with more than what it is about."""

import datetime as dt
import glob
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom import session
from ledgerloom.functions import identity, indexing
from ledgerloom.functions.numbers import parse_number
from ledgerloom.operators import categorize as cat
from ledgerloom.operators import columns as col
from ledgerloom.operators import convert, review
from ledgerloom.operators import transactions as tr
from ledgerloom.plans import generation
from ledgerloom.sources import store, tables
from ledgerloom.streaming import incremental
from ledgerloom.workload import mapping_queries, money_queries, rule_queries


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_rows_with_copies_are_moved_to_be_numbered(spark, monkeypatch):
    rows = [(f, i, i // 4, f"h{i % 7 if i < 20 else i}") for f in ("a", "b", None) for i in range(40)]
    moved = []
    plain = identity.occurrence_number
    monkeypatch.setattr(identity, "occurrence_number", lambda df, *a: moved.append(df) or plain(df, *a))
    df = spark.createDataFrame(rows, "file_id string, row_index int, row_block int, base_hash string")
    out = identity.with_final_hash(df)
    assert out.columns == [*df.columns, "dup", "hash"]
    seen, want = Counter(), set()
    for f, i, _, h in rows:
        want.add((f, i, h, seen[f, h]))
        seen[f, h] += 1
    got = out.collect()
    assert {(r["file_id"], r["row_index"], r["base_hash"], r["dup"]) for r in got} == want and len(got) == len(rows)
    assert len({(r["file_id"], r["hash"]) for r in got}) == len(rows)
    assert moved[0].count() == sum(n for n in seen.values() if n > 1) == 60


def test_number_text_is_trimmed_once(spark):
    df = spark.createDataFrame([(" +1 234,50",)], "t string").select(parse_number(F.col("t")).alias("n"))
    assert df.collect()[0]["n"] == 1234.5
    assert _plan(df).count("trim(") == 1


def test_earlier_import_reads_its_lines_once(spark, tmp_path, monkeypatch):
    """The marks of a line come with its row, so rows are not joined to their own lines."""
    day = dt.datetime(2024, 1, 2)
    lines = [(k, 1, 1, k % 7 + 1, 40.0 + k, 10.0, 0.1, 0.0, "RAN"[k % 3], "O", day) for k in range(9)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = "p_partkey long, p_name string, p_type string, p_size int"
    spark.createDataFrame([(1, "red anvil", "PROMO", 3)], part).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "S1", 1)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = rule_queries.stored_footprints(spark, str(tmp_path))
    assert found.count() == 3 and "l_returnflag" not in found.columns
    assert not re.search(r"src_row#\d+L = src_row#\d+L", _plan(found))


def test_operations_look_their_cells_up_once(spark):
    fields = ("1", m.DATE, "yyyy-MM-dd"), ("2", m.AMOUNT, None), ("3", m.BANK_COMMISSION, None), ("4", m.DESCRIPTION, None)
    entries = [("f", i, n, d, f, "outcome" if d == m.AMOUNT else None, "use_base", None, None, None) for i, (n, d, f) in enumerate(fields)]
    mapping = spark.createDataFrame(entries, "file_id string, col_id int, name string, definition string, date_format string, amount_type string, currency_mode string, currency_code string, success_value string, recall_state string")
    rows = spark.createDataFrame(
        [("f", 0, 0, ["2024-01-02", "-5,00", "1", "shop"]), ("f", 1, 0, ["x", "7", "", " "]), ("none", 0, 0, ["2024-01-02"])],
        "file_id string, row_index int, row_block int, cells array<string>",
    )
    typed = col.typed_rows(rows, tr.with_amount_choice(col.file_columns(mapping), "EUR"))
    got = tr.operations(typed, "EUR").orderBy("source_row", "kind_order").collect()
    assert [(r["source_row"], r["kind"], r["state"], r["reason"], r["amount"], r["currency"]) for r in got] == [
        (0, "main", "ok", None, 5.0, "EUR"),
        (0, "commission", "ok", None, 1.0, "EUR"),
        (1, "main", "error", "date-parse-failed", 7.0, "EUR"),
    ]
    plan = _plan(tr.operations(typed, "EUR"))
    assert plan.count("filter(typed") <= 30


def test_first_cells_are_looked_up_without_lambdas(spark):
    rows = [([(None, ("a",)), ("CATEGORY", ("b",)), ("CATEGORY", ("c",))],), ([("X", ("a",))],), ([],), (None,)]
    df = spark.createDataFrame(rows, "typed array<struct<definition string, v struct<text string>>>")
    found = df.select(tr.first_text(m.CATEGORY).alias("t"))
    assert [r["t"] for r in found.collect()] == ["b", None, None, None]
    assert "lambda" not in _plan(found)


def _lines(spark, folder):
    """Nine lines of two statements in three files, two of them alike."""
    day = dt.datetime(2024, 1, 2)
    lines = [(max(k, 1), 1, k % 2 + 1, k % 7 + 1, 40.0 + k, 10.0, 0.1, 0.0, "RAN"[k % 3], "O", day) for k in range(9)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    part = "p_partkey long, p_name string, p_type string, p_size int"
    spark.createDataFrame([(1, "red anvil", "PROMO", 3)], part).write.parquet(f"{folder}/part.parquet")
    suppliers = [(1, "S1", 1), (2, "S2", 2)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")


def test_hashed_rows_meet_parts_and_suppliers_once(spark, tmp_path):
    """The ladder and the duplicate check read stored rows, which are not joined anew."""
    _lines(spark, tmp_path)
    for plan in (_plan(rule_queries.laddered(spark, str(tmp_path))), _plan(money_queries.d7(spark, str(tmp_path)))):
        assert "p_partkey" not in plan and "s_suppkey" not in plan and "l_suppkey" not in plan
    assert money_queries.d7(spark, str(tmp_path)).where("dup").count() == 3


def test_the_place_of_a_file_is_met_without_moving_rows(spark, tmp_path):
    _lines(spark, tmp_path)
    df = tables.read_with_position(spark, str(tmp_path), "lineitem")
    assert sorted(r["src_row"] for r in df.collect()) == list(range(9))
    assert "Window" not in _plan(df)


def test_stored_decisions_are_met_by_bits_of_their_key(spark):
    """Keys with a null meet nothing; columns and rows are those of a join on the key."""
    day = dt.date(2024, 1, 2)
    rows = spark.createDataFrame([("a", day), ("a", None), ("b", day), (None, day), ("c", day)], "hash string, date date")
    kept = [("a", 2024, 1, "food"), ("a", None, None, "food"), (None, 2024, 1, "food"), ("b", 2024, 2, "food"), ("c", 2024, 1, "gone")]
    overrides = spark.createDataFrame(kept, "hash string, year int, month int, override_category string")
    categories = spark.createDataFrame([("food",)], "id string")
    out = cat.with_override(rows, overrides, categories)
    assert out.columns == ["hash", "year", "month", "date", "override_category", "valid_override"]
    want = {("a", day): ("food", "food"), ("c", day): ("gone", None)}
    got = {(r["hash"], r["date"]): (r["override_category"], r["valid_override"]) for r in out.collect()}
    assert len(got) == 5 and all(v == want.get(k, (None, None)) for k, v in got.items())
    assert not re.search(r"hash#\d+ = hash#\d+", _plan(out))
    marked = store.mark_duplicates(cat.with_period(rows), overrides)
    assert sorted((r["hash"], r["date"]) for r in marked.where("dup").collect()) == sorted(want)
    assert marked.count() == 5 and not re.search(r"hash#\d+ = hash#\d+", _plan(marked))


def test_rates_are_met_without_moving_rows(spark):
    """Quotes are worked out once and stored, so their size is known."""
    quoted = spark.createDataFrame([("USD", dt.date(2024, 1, 2), "EUR", 0.5)], "base string, date date, ccy string, rate double")
    rows = spark.createDataFrame([(dt.date(2024, 1, 2), "USD", 3.0)], "date date, currency string, amount double")
    out = convert.with_converted(rows, quoted, "EUR")
    assert [r["converted"] for r in out.collect()] == [1.5]
    assert "Aggregate" not in _plan(out)


def test_a_stored_step_leaves_no_shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    kept = session.materialize(spark.range(1000).repartition(3, "id"), "moved")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 1000
    assert spark.conf.get(session._FREE, None) is None


def test_numbered_rows_meet_no_table(spark):
    """The start of a block comes as one of its rows; null groups, ties of blocks and types stay."""
    rows = [(g, i // 4, i, [str(i)], dt.date(2024, 1, 2)) for g in ("a", None) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, b long, i int, cells array<string>, day date")
    out = indexing.dense_index(df, ["g"], "b", ["i"])
    assert "Join" not in _plan(out) and out.dtypes == [*df.dtypes, ("row_index", "bigint")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r, r[2]) for r in rows), key=str)


def _ops(spark, rows):
    names = "file_id string, source_row long, row_block long, kind string, kind_order int, state string, reason string, amount double, base_hash string"
    return spark.createDataFrame(rows, names)


def test_operations_are_moved_once_to_become_transactions(spark, monkeypatch):
    rows = [("f", i, i // 3, k, o, "error" if i == 2 else "ok", None, 1.0, f"{k}{i % 4}") for i in range(9) for o, k in enumerate(("main", "cashback"))]
    seen, plain = [], tr.with_final_hash
    monkeypatch.setattr(tr, "with_final_hash", lambda df, *a: seen.append(df.columns) or plain(df, *a))
    ops = _ops(spark, rows)
    out = tr.transactions(ops)
    assert "row_index" not in seen[0] and out.columns == [c for c in ops.columns if c not in ("state", "reason")] + ["row_index", "dup", "hash"]
    kept, copies, want = [r for r in rows if r[5] == "ok"], Counter(), []
    for n, r in enumerate(kept):
        want.append((r[1], r[3], n, copies[r[8]]))
        copies[r[8]] += 1
    assert sorted((r["source_row"], r["kind"], r["row_index"], r["dup"]) for r in out.collect()) == sorted(want)


def test_error_and_skipped_rows_meet_their_source_together(spark):
    ops = _ops(spark, [("f", i, 0, "main", 0, s, s, 1.0, "h") for i, s in enumerate(("ok", "error", "skipped"))])
    cell = [(m.AMOUNT, (None, 5.0, None))]
    typed = spark.createDataFrame(
        [("f", i, cell) for i in range(3)], "file_id string, row_index long, typed array<struct<definition string, v struct<text string, number double, date date>>>"
    )
    kept = ops.where("state = 'ok'").selectExpr("file_id", "source_row row_index", "date'2024-01-02' date", "amount", "'EUR' currency", "'x' description")
    out = review.review(kept, ops, typed)
    assert sorted((r["state"], r["row_index"], r["amount"]) for r in out.collect()) == [("error", 1, 5.0), ("ok", 0, 1.0), ("skipped", 2, 5.0)]
    assert _plan(out).count("Join") == 1


def test_typed_rows_of_a_review_are_stored_once(spark, tmp_path, monkeypatch):
    """Large steps are stored once, compressed; typed rows do not carry their texts twice."""
    _lines(spark, tmp_path)
    kept, plain = [], session.materialize
    for of in (generation, mapping_queries):
        monkeypatch.setattr(of, "materialize", lambda df, name, **o: kept.append((name, df.columns, o)) or plain(df, name, **o))
    assert mapping_queries.reviewed(spark, str(tmp_path)).count() >= 0
    names = [name for name, _, _ in kept]
    assert all(names.count(name) == 1 for name in ("raw", "typed", "ops"))
    assert all(o == {"compression": "zstd"} for name, _, o in kept if name in ("raw", "typed", "ops"))
    assert "cells" not in dict((name, columns) for name, columns, _ in kept)["typed"]


def test_a_commit_moves_stored_and_new_records_once(spark, tmp_path, monkeypatch):
    h = identity.final_hash(F.lit("a"), F.lit(0))
    known = spark.range(1).select(h.alias("h")).first()["h"]
    old = [(2024, 1, 2, 1.0, "old", x, 0) for x in (known, "AB", "b", "odd")] + [(2024, 1, 2, 9.0, "old", None, 0)] * 2
    new = [(2024, 1, 3, 2.0, c, x, i) for x in (known, "ab", "b", None) for c, i in (("new", 0), ("mine", 1))]
    was, batch = (spark.createDataFrame(x, store.FOOTPRINT) for x in (old, new))
    merged = store.merge_into_store(was, batch)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(merged) == order(store.merge_footprints(was, batch).select(*was.columns)) and merged.columns == was.columns
    assert "Join" not in _plan(merged)
    stored = []
    monkeypatch.setattr(store, "materialize", lambda df, name, **o: stored.append(name) or df)
    priced = spark.createDataFrame([(dt.date(2024, 1, 2), "USD", 1.0, False, "food", known, 0)], "date date, currency string, amount_usd double, rate_missing boolean, category_id string, hash string, is_manual int")
    assert tuple(priced.columns) == store.PRICED
    store.commit(spark, str(tmp_path), priced)
    assert not stored and store.read_store(spark, str(tmp_path)).count() == 1


def test_an_import_stores_what_its_commit_reads(spark, tmp_path, monkeypatch):
    stored, plain = [], session.materialize
    monkeypatch.setattr(incremental, "materialize", lambda df, name, **o: stored.append((name, tuple(df.columns), o)) or plain(df, name, **o))
    names = "file_id string, date date, amount double, currency string, description string, counterparty string, account string, bank_category string, mcc string, is_bank_commission boolean, is_cashback boolean, base_hash string, hash string"
    rows = spark.createDataFrame([("f", dt.date(2024, 1, 2), 1.0, "USD", *"xxxxx", False, False, "a", "b")], names)
    none = spark.createDataFrame([], "base string, date date, ccy string, rate double")
    kinds = spark.createDataFrame([("other", "Other", "base", False)], "id string, name string, currency string, is_archived boolean")
    incremental.batch_import(spark, str(tmp_path), (), kinds, none, "other")(rows, 0)
    assert stored == [("priced", store.PRICED, {"compression": "zstd"})]
    assert [r["category_id"] for r in store.read_store(spark, str(tmp_path)).collect()] == ["other"]
