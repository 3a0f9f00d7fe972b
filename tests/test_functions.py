import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import currency as cur
from ledgerloom.functions import indexing, stats
from ledgerloom.functions import text as tx
from ledgerloom.functions.dates import DATE_FORMATS, parse_date
from ledgerloom.functions.numbers import parse_number
from ledgerloom.operators.conditions import UnsafePattern, check_pattern


def column(spark, values, build, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[1] for r in df.select("i", build(F.col("v"))).orderBy("i").collect()]


def test_parse_number(spark):
    cases = {
        "1 234,56": 1234.56,
        "1,234.56": 1234.56,
        "1.234.567,89": 1234567.89,
        "1,234,567.89": 1234567.89,
        "1,234": 1.234,
        "-42,00": -42.0,
        "+50,00": 50.0,
        "1'000.5": 1000.5,
        " 12 ": 12.0,
        "": None,
        "abc": None,
        "12+3": None,
        "12-3": None,
        "—": None,
        "$5": None,
        ".5": 0.5,
        "5.": 5.0,
    }
    assert column(spark, list(cases), parse_number) == list(cases.values())


def test_null_like(spark):
    values = ["", " - ", "—", "N/A", "null", "0", "x", None]
    assert column(spark, values, tx.is_null_like) == [True, True, True, True, True, False, False, True]


def test_dates_are_strict(spark):
    assert "dd.MM.yyyy" in DATE_FORMATS
    got = column(spark, ["15.01.2024 08:00", "5.1.2024", "31.02.2024", "2024-01-15"], lambda c: parse_date(c, "dd.MM.yyyy"))
    assert [str(d) if d else None for d in got] == ["2024-01-15", None, None, None]
    assert str(column(spark, ["01/02/69"], lambda c: parse_date(c, "dd/MM/yy"))[0]) == "2069-02-01"


def test_tokens(spark):
    assert column(spark, ["Red WIDGET ab x1y 42 café"], tx.tokens)[0] == ["red", "widget", "caf"]


def test_label(spark):
    df = spark.createDataFrame([(" ", None, "c", "5411"), (None, None, None, None)], "d string, p string, b string, m string")
    label = tx.display_label(F.col("d"), F.col("p"), F.col("b"), F.col("m"))
    assert [r[0] for r in df.select(label).collect()] == ["c", "—"]


def test_currency_lookup(spark):
    iso = column(spark, ["USD", "₴", "€", "грн", "??"], cur.symbol_to_iso)
    assert iso == ["USD", "UAH", "EUR", "UAH", None]
    ambiguous = {r["symbol"] for r in cur.ambiguous_symbols(cur.currency_frame(spark)).collect()}
    assert {"$", "¥", "kr"} <= ambiguous and "€" not in ambiguous


@pytest.mark.parametrize("bad", ["(a+)+", "(a*)*", "(.*a){10}", "(\\d+)+", "((x)+y)*", "(a+)?"])
def test_nested_quantifiers_are_rejected(bad):
    with pytest.raises(UnsafePattern):
        check_pattern(bad)


@pytest.mark.parametrize("good", ["a+b*", "(ab)+", "[(+)]+", "\\(a+\\)+", "((a+))+", "(a|b)?"])
def test_flat_patterns_pass(good):
    check_pattern(good)


def test_dense_index_and_occurrences_do_not_depend_on_blocks(spark):
    rows = [(i % 3, i, "same" if i % 2 else f"v{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "g int, at long, h string")
    small = df.withColumn("block", indexing.block_of(F.col("at"), 7))
    large = df.withColumn("block", indexing.block_of(F.col("at"), 10_000))
    for fn, group in ((indexing.dense_index, ["g"]), (indexing.occurrence_number, ["g", "h"])):
        a = {(r["g"], r["at"]): r["n"] for r in fn(small, group, "block", ["at"], "n").collect()}
        b = {(r["g"], r["at"]): r["n"] for r in fn(large, group, "block", ["at"], "n").collect()}
        assert a == b
        seen: dict = {}
        for g, at, h in sorted(rows, key=lambda r: r[1]):
            key = (g,) if group == ["g"] else (g, h)
            assert a[(g, at)] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + 1


def test_even_sample_matches_its_definition(spark):
    for total, size in ((7, 7), (10, 3), (1234, 100), (999, 998)):
        df = spark.range(total)
        hit = indexing.in_even_sample(F.col("id"), F.lit(total), F.lit(size))
        assert [r[0] for r in df.where(hit).orderBy("id").collect()] == [i * total // size for i in range(size)]


def test_weighted_median_is_exact(spark):
    rows = [("a", float(v), n) for v, n in ((1, 3), (2, 1), (5, 2), (-7, 4), (0, 1))] + [("b", 3.5, 1), ("b", 4.5, 1)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = dict(stats.weighted_median(df, ["g"], "v", "n", "m").collect())
    flat = sorted(v for g, v, n in rows if g == "a" for _ in range(n))
    assert got == {"a": flat[len(flat) // 2], "b": 4.0}


def test_huge_number_keeps_its_text(spark):
    from ledgerloom.functions.identity import number_text

    rows = spark.createDataFrame([(1e31,), (1.5,)], "x double").select(number_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["1.0E31", "1.5000000000"]


def test_first_definition_is_saved_and_conflicts_are_told(spark):
    from ledgerloom.operators import recall

    kind = "key string, definition string, params struct<format:string>"
    pool = spark.createDataFrame([], kind.replace("key", "column_name"))
    new = spark.createDataFrame([("k", "TIME", ("b",)), ("k", "DATE", ("a",)), ("l", "DATE", ("a",)), ("l", "DATE", ("a",))], kind)
    saved = sorted((r["column_name"], r["definition"]) for r in recall.save_new(pool, new).collect())
    assert saved == [("k", "DATE"), ("l", "DATE")]
    assert [tuple(r) for r in recall.conflicts(new).collect()] == [("k", 2)]


def test_currencies_from_a_table(spark):
    from ledgerloom.operators import columns

    baht = ("THB", 764, 2, "฿", "THB", "Baht", "бат", [], 100)
    maps = cur.frame_maps(cur.currency_frame(spark).union(spark.createDataFrame([baht], cur._SCHEMA)))
    rows = spark.createDataFrame([("thb",), ("764",), ("฿",), ("USD",)], "raw string")
    assert [r["c"] for r in rows.select(columns.as_currency(F.col("raw"), maps)["text"].alias("c")).collect()] == ["THB"] * 3 + ["USD"]
    assert rows.where("raw = 'thb'").select(columns.as_currency(F.col("raw"))["text"].alias("c")).first()["c"] is None


def test_files_without_rows_are_schema_errors(spark):
    from ledgerloom.operators import headers

    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["a"]), (2, ["a", "b"])], "file_id long, keys array<string>")
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    found = {(r["file_id"], r["reason"]) for r in headers.schema_errors(rows, files).collect()}
    assert found == {(2, "different-columns"), (3, "no-rows")}
