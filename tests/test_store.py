import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.identity import base_hash, field_texts, with_final_hash
from ledgerloom.operators import typicality as ty
from ledgerloom.operators.convert import with_usd
from ledgerloom.session import shared_dir
from ledgerloom.sources import store


def batch(spark, rows):
    schema = "file_id string, row_index long, date date, amount double, currency string, description string"
    df = spark.createDataFrame(rows, schema).withColumn("row_block", F.lit(0).cast("long"))
    df = df.withColumn("base_hash", base_hash(field_texts(df), F.lit("main")))
    return with_final_hash(df).withColumn("category_id", F.lit("x")).withColumn("is_manual", F.lit(0))


def rates(spark):
    return spark.createDataFrame(
        [("USD", dt.date(2024, 1, d), c, r) for d in (1, 2, 3) for c, r in (("UAH", 41.0), ("EUR", 0.92))],
        "base string, date date, ccy string, rate double",
    )


def rows(*days, amount=100.0, currency="UAH"):
    return [("f", i, dt.date(2024, 1, d), amount, currency, "shop") for i, d in enumerate(days)]


def test_money_direction(spark):
    priced = with_usd(batch(spark, rows(1) + rows(2, currency="EUR")), rates(spark)).orderBy("currency").collect()
    assert [round(r["amount_usd"], 4) for r in priced] == [108.6957, 2.439]


def test_commit_is_idempotent_and_keeps_copies(spark):
    path = shared_dir(spark, "test-store")
    priced = with_usd(batch(spark, rows(1, 1, 2)), rates(spark))
    store.commit(spark, path, priced)
    assert store.read_store(spark, path).count() == 3
    store.commit(spark, path, priced)
    assert store.read_store(spark, path).count() == 3
    more = with_usd(batch(spark, rows(1, 1, 2, 3)), rates(spark))
    store.commit(spark, path, more)
    assert store.read_store(spark, path).count() == 4


def test_missing_rate_writes_nothing(spark):
    path = shared_dir(spark, "test-store")
    with pytest.raises(store.RatesMissing):
        store.commit(spark, path, with_usd(batch(spark, rows(1, 9)), rates(spark)))
    assert store.read_store(spark, path).count() == 0


def test_key_twice_in_a_batch_is_one_record(spark):
    """Two overlapping files of one commit give the same hashes."""
    path = shared_dir(spark, "test-store")
    first, second = rows(1, 1, 2), [("g", *r[1:]) for r in rows(1, 1, 2, 3, 3, 3)]
    store.commit(spark, path, with_usd(batch(spark, first + second), rates(spark)))
    assert store.read_store(spark, path).count() == 6
    table = spark.createDataFrame([(1, "a")], "id long, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d"), (2, "d")], "id long, v string")
    assert sorted(map(tuple, store.upsert_rows(table, twice, ["id"]).collect())) == [(1, "c"), (2, "d")]
    assert [tuple(r) for r in store.update_rows(table, twice, ["id"]).collect()] == [(1, "c")]


def test_manual_decision_stays_among_equal_keys(spark):
    priced = with_usd(batch(spark, rows(1)), rates(spark))
    manual = priced.withColumn("is_manual", F.lit(1)).withColumn("category_id", F.lit("a"))
    merged = store.merge_footprints(store.footprint_of(priced).limit(0), store.footprint_of(priced.unionByName(manual)))
    assert [(r["category_id"], r["is_manual"]) for r in merged.collect()] == [("a", 1)]


def test_periods_reach_the_scan(spark):
    path = shared_dir(spark, "test-store")
    stored = spark.createDataFrame(
        [(y, m, 1, 1.0, "x", f"h{y}{m}", 0) for y in (2023, 2024) for m in range(1, 13)], store.FOOTPRINT
    )
    store.put_batch(spark, path, stored)
    wanted = spark.createDataFrame([(2024, 3), (2023, 5)], "year int, month int")
    found = store.of_periods(store.read_store(spark, path), wanted)
    assert sorted(r["hash"] for r in found.collect()) == ["h20235", "h20243"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((" in plan and "month" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(store.read_store(spark, path, [(2024, 3)]).inputFiles()) == 1


def test_failed_commit_changes_nothing(spark, monkeypatch):
    path = shared_dir(spark, "test-store")
    store.commit(spark, path, with_usd(batch(spark, rows(1, 2)), rates(spark)))
    monkeypatch.setattr(store, "_LIST_SCHEMA", "version long")
    with pytest.raises(Exception):  # noqa: B017
        store.put_batch(spark, path, store.footprint_of(with_usd(batch(spark, rows(3)), rates(spark))))
    monkeypatch.undo()
    assert store.read_store(spark, path).count() == 2


def test_hash_set_ignores_row_order(spark):
    one = {r["hash"] for r in batch(spark, rows(1, 2, 1, 3, 1)).collect()}
    two = {r["hash"] for r in batch(spark, rows(3, 1, 1, 2, 1)).collect()}
    assert one == two and len(one) == 5


def bucket(spark, values):
    schema = "bucket long, row_index long, mcc string, counterparty string, currency string, bank_category string, amount double, description string"
    return spark.createDataFrame([(1, i, *v) for i, v in enumerate(values)], schema)


def flags(spark, values):
    df = bucket(spark, values)
    return [r["row_index"] for r in ty.flagged(ty.score(df, ty.fit(df, {}))).collect()]


def test_typicality(spark):
    usual = ("5411", "shop", "UAH", "food", 100.0, "market purchase")
    odd = ("7995", "shop", "UAH", "food", 100.0, "market purchase")
    assert flags(spark, [usual] * 4 + [odd]) == []
    assert flags(spark, [usual] * 12) == []
    assert flags(spark, [usual] * 12 + [odd]) == [12]
    amounts = [("5411", "shop", c, "food", a, "market purchase") for c in ("UAH", "USD") for a in (80.0, 90.0, 100.0, 110.0, 130.0, 150.0)]
    huge = ("5411", "shop", "USD", "food", 5000.0, "market purchase")
    assert flags(spark, [*amounts, huge]) == [12]


def test_lookup_by_hash_skips_row_groups(spark):
    """A hash between the stored ones is refused by the Bloom filter; no row is read."""
    path = shared_dir(spark, "test-store")
    entries = [(2024, 1, 1, 1.0, "x", f"{i * 7919 % 1000:06d}", 0) for i in range(0, 1000)]
    store.put_batch(spark, path, spark.createDataFrame(entries, store.FOOTPRINT))

    def scanned(value):
        found = store.find_by(store.read_store(spark, path), "hash", value)
        n = len(found.collect())
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert "EqualTo(hash" in leaf.metadata().get("PushedFilters").get()
        return n, leaf.metrics().get("numOutputRows").get().value()

    assert scanned("000500x") == (0, 0)
    assert scanned("000500")[0] == 1
    files = store.read_store(spark, path).withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id())
    for r in files.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("h")).collect():
        assert [x["hash"] for x in r["h"]] == sorted(x["hash"] for x in r["h"])
