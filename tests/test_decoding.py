import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import model as m
from ledgerloom.functions.indexing import block_of
from ledgerloom.operators import csv, detect
from ledgerloom.plans import decoding
from ledgerloom.plans.decoding import decode_files, decode_lines
from ledgerloom.sources import statement_files as files

MONO = """"Дата i час операції","Деталі операції","MCC","Сума","Валюта","Комісія","Кешбек"
"15.01.2024 08:23:14","TEST COFFEE 1","5814","-42,00","UAH","—","0,42"
"15.01.2024 14:12:00","TEST ATM","6011","-500,00","UAH","-5,00","—"
" - "," - "," - "," - "," - "," - "," - "
"16.01.2024 09:00:00","TEST CAFE 2","5812","-85,00","UAH","—","0,85"
"""
RAGGED = (
    "Date\tDescription\tAmount\tCurrency\n"
    "15.01.2024\tTEST PAYMENT 1\t-100.00\tUAH\n"
    "16.01.2024\tTEST PAYMENT 2\t-250.50\tUAH\tEXTRA_COL\n"
    "17.01.2024\tTEST PAYMENT 3 short\n"
    "18.01.2024\tTEST PAYMENT 4\t-75.00\tUAH\n"
    '19.01.2024\tTEST PAYMENT 5 with "bare quote inside\t-90.00\tUAH\n'
    "20.01.2024\tTEST PAYMENT 6\t-140.00\tUAH\n"
)
BLANK_HEADER = "Дата,,Опис,Сума,Опис\n01.02.2024,x,Кава,-1,a\n02.02.2024,y,Чай,-2,b\n03.02.2024,z,Обід,-3,c\n"


@pytest.fixture(scope="module")
def decoded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("statements")
    files = {
        "mono.csv": MONO.encode(),
        "ragged.csv": RAGGED.encode(),
        "bom.csv": b"\xef\xbb\xbf" + b"Date,Description,Amount\r\n15.01.2024,PAY 1,-100.00\r\n16.01.2024,PAY 2,-1.00\r\n",
        "blank.csv": BLANK_HEADER.encode(),
        "cp1251.csv": "Дата;Опис;Сума\n01.02.2024;Кава в кафе;-10,00\n02.02.2024;Чай;-20,00\nРазом;;-30,00\n".encode("cp1251"),
        "mac.csv": b"Date,Details,Amount\r15.01.2024,A,-1\r16.01.2024,B,-2",
        "book.csv": b"PK\x03\x04 not text\n",
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    out = decode_files(spark, str(folder))
    short = lambda df: df.withColumn("file", F.element_at(F.split("file_id", "/"), -1))
    rows = {}
    for r in short(out.rows()).orderBy("file", "row_index").collect():
        rows.setdefault(r["file"], []).append(r)
    issues = {}
    for r in short(out.issues()).collect():
        issues.setdefault(r["file"], []).append(r["what"])
    meta = {r["file"]: r for r in short(out.meta()).collect()}
    return rows, issues, meta


def test_rows_per_file(decoded):
    rows, _, _ = decoded
    assert {f: len(r) for f, r in rows.items()} == {
        "mono.csv": 3, "ragged.csv": 3, "bom.csv": 2, "blank.csv": 3, "cp1251.csv": 2, "mac.csv": 2,
    }


def test_delimiters_and_encodings(decoded):
    meta = decoded[2]
    assert {f: (m["delimiter"], m["encoding"], m["bom"]) for f, m in meta.items()} == {
        "mono.csv": (",", "utf-8", False),
        "ragged.csv": ("\t", "utf-8", False),
        "bom.csv": (",", "utf-8", True),
        "blank.csv": (",", "utf-8", False),
        "cp1251.csv": (";", "windows-1251", False),
        "mac.csv": (",", "utf-8", False),
    }


def test_cells(decoded):
    rows = decoded[0]
    assert rows["mono.csv"][0]["cells"][3] == "-42,00"
    assert rows["cp1251.csv"][0]["cells"] == ["01.02.2024", "Кава в кафе", "-10,00"]
    assert rows["blank.csv"][0]["keys"] == ["Дата", "col_2", "Опис", "Сума", "Опис_2"]
    # The short row scores best as header here, so the rows in front of it
    # are preamble and the wider ones keep their extra cells.
    assert rows["ragged.csv"][1]["keys"] == ["17.01.2024", "TEST PAYMENT 3 short", "col_3", "col_4"]
    assert rows["ragged.csv"][1]["cells"][1] == 'TEST PAYMENT 5 with "bare quote inside'


def test_rows_keep_physical_line_numbers(decoded):
    rows = decoded[0]
    assert [r["src_row"] for r in rows["mac.csv"]] == [1, 2]
    assert [r["src_row"] for r in rows["mono.csv"]] == [1, 2, 4]


def test_issues(decoded):
    issues = decoded[1]
    assert sorted(issues["ragged.csv"]) == ["bare-quote", *["preamble-row"] * 3, *["ragged-long"] * 3]
    assert issues["mono.csv"] == ["placeholder-row"]
    assert sorted(issues["blank.csv"]) == ["duplicate-column", "empty-header-cell"]
    assert issues["cp1251.csv"] == ["summary-row"]
    assert issues["book.csv"] == ["spreadsheet-container"]


def by_hand(lines, d=",", far=10):
    """Record starts found by reading character by character."""
    starts, i = [], 0
    while i < len(lines):
        starts.append(i)
        inside, field_start, line = False, True, i
        while True:
            k, text = 0, lines[line]
            while k < len(text):
                ch = text[k]
                if inside:
                    if ch == '"' and text[k + 1 : k + 2] == '"':
                        k += 1
                    elif ch == '"':
                        inside = False
                elif ch == '"' and field_start:
                    inside = True
                field_start = not inside and ch == d
                k += 1
            if not inside:
                break
            closes = None
            for n in range(line + 1, min(line + far, len(lines))):
                runs = [len(r) for r in re.findall(r'"+', lines[n])]
                if any(r % 2 for r in runs):
                    closes = n
                    break
            if closes is None:
                break
            line = closes
            # Read on behind the closing quote of that line.
            m = re.match(r'[^"]*(?:""[^"]*)*"', lines[closes])
            lines = [*lines]
            lines[closes] = "x" + lines[closes][m.end() :]
            inside, field_start = False, False
        i = line + 1
    return starts


@pytest.mark.parametrize("block", [3, 4096])
def test_records_over_line_ends(spark, monkeypatch, block):
    monkeypatch.setattr(csv, "STITCH_LINES", block)
    texts = {
        1: ['a,"one', "two", 'three",b', "plain,x", 'c,"q ""w""', 'more"', "end"],
        2: ['a,"never closed', *["filler"] * 12, "last,row"],
        3: ['a,"x', 'y","z', 'w",end', "k,l"],
        4: ['"p', 'q","r', *["mid"] * 7, 's",t', "u"],
        5: ['say "hi", "x', "next", '"quoted" tail,z', "done"],
    }
    rows = [(f, i, line) for f, lines in texts.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file_id long, src_row long, line string").withColumn(
        "row_block", block_of(F.col("src_row"))
    )
    found = csv.records(lines.withColumn("delimiter", F.lit(",")))
    got: dict[int, list[int]] = {}
    for r in found.orderBy("file_id", "src_row").collect():
        got.setdefault(r["file_id"], []).append(r["src_row"])
    assert got == {f: by_hand(x) for f, x in texts.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_quoted_fields_of_many_lines(spark, monkeypatch, block):
    monkeypatch.setattr(csv, "STITCH_LINES", block)
    texts = {
        1: ['a,"one', *["mid"] * 40, 'end","two', *["mid"] * 25, 'end"', "x,y"],
        2: ["a,b", 'c,"never closed', *["filler"] * 30, "last,row"],
    }
    rows = [(f, i, line) for f, lines in texts.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file_id long, src_row long, line string").withColumn("row_block", block_of(F.col("src_row")))
    found = csv.records(lines.withColumn("delimiter", F.lit(","))).collect()
    starts = {f: sorted(r["src_row"] for r in found if r["file_id"] == f) for f in texts}
    assert starts == {1: [0, len(texts[1]) - 1], 2: list(range(len(texts[2])))}
    assert max((r["record"] for r in found), key=len) == "\n".join(texts[1][:-1])


def test_maps_compose_over_a_tree_of_blocks(spark, monkeypatch):
    """Blocks of two lines in groups of two: five levels, against reading line by line."""
    monkeypatch.setattr(csv, "STITCH_LINES", 2)
    monkeypatch.setattr(csv, "FAN", 2)
    rng = random.Random(4)
    pieces = ["a,b", 'x,"open', 'close"', 'close","again', '"q",z', 'bare "quote', "", '""', 'e,"d""']
    texts = {f: [rng.choice(pieces) for _ in range(rng.randrange(1, 60))] for f in range(25)}
    rows = [(f, i, line) for f, lines in texts.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "file_id long, src_row long, line string").withColumn("row_block", block_of(F.col("src_row")))
    for given in (lines, csv.line_table(lines)):
        found = csv.records(given.withColumn("delimiter", F.lit(","))).collect()
        for f, held in texts.items():
            # a field stays open only where a later line of the file closes one
            assert sorted(r["src_row"] for r in found if r["file_id"] == f) == by_hand(held, far=len(held)), held


def test_a_decode_reads_the_text_three_times(spark, monkeypatch):
    """The line table is made in one scan; single and joined lines are read once each."""
    lines = spark.createDataFrame([(1, i, f'a,"b{i}') for i in range(9)], "file_id long, src_row long, line string")
    lines = lines.withColumn("row_block", F.lit(0).cast("long"))
    plans = []
    kept = csv.materialize

    def seen(df, purpose):
        plans.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, purpose)

    monkeypatch.setattr(csv, "materialize", seen)
    monkeypatch.setattr(decoding, "materialize", seen)
    decode_lines(lines)
    scans = [p for _, plan in plans for p in re.findall(r"Scan (?:parquet|ExistingRDD)[^\n]*", plan) if re.search(r"\bline(?:#|:string)", p)]
    assert len(scans) == 3
    windows = [w for _, plan in plans for w in re.findall(r"windowspecdefinition\(([^)]*)", plan)]
    assert [p for p, _ in plans][:5] == ["lines", "delimiters", "walked", "block-maps", "continued"]
    assert windows and all("_block" in w for p, plan in plans[:6] for w in re.findall(r"windowspecdefinition\(([^)]*)", plan))


def test_date_formats_are_counted_over_all_cells(spark):
    rows = spark.range(20_000).selectExpr("1L AS file_id", "id AS row_index", "array('15.01.2024') AS cells")
    bad = detect.even_sample(rows).select("row_index", F.lit(True).alias("bad"))
    assert bad.count() == 1000
    cells = F.when(F.col("bad"), F.array(F.lit("none"))).otherwise(F.col("cells"))
    rows = rows.join(bad, "row_index", "left").select("file_id", "row_index", cells.alias("cells"))
    mapping = spark.createDataFrame(
        [(1, 0, m.DATE, "auto", None, None)],
        "file_id long, col_id int, definition string, date_format string, amount_type string, success_value string",
    )
    assert detect.undetected(detect.resolve_auto(rows, mapping)).count() == 0


def test_field_splitting(spark):
    cases = {
        'a,b,"c,d",': ["a", "b", "c,d", ""],
        '"x ""y"" z",w': ['x "y" z', "w"],
        '"a"b,c': ["ab", "c"],
        '"open,end': ["open,end"],
        ",,": ["", "", ""],
        '"",x': ["", "x"],
        'k"e"y,"v"': ['k"e"y', "v"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string")
    out = {r["r"]: r["c"] for r in df.select("r", csv.split_record(F.col("r"), F.lit(",")).alias("c")).collect()}
    assert out == cases


def test_heads_route_files_by_their_first_bytes(spark, tmp_path):
    contents = {
        "a b.csv": b"PK\x03\x04rest\n\n",
        "old.csv": bytes.fromhex("D0CF11E0A1B11AE1") + b"\n" * 5000,
        "real.xls": bytes.fromhex("D0CF11E0A1B11AE1"),
        "marked.csv": b"\xef\xbb\xbfDate;Sum\n",
        "named.XLSX": b"Date;Sum\n",
        "empty.txt": b"",
        "short.csv": b"PK",
    }
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in contents.items()], "name string, body binary")
    folder = f"file://{tmp_path}/files"
    assert {tuple(r) for r in files.write_files(rows, folder).collect()} == {(n, len(b)) for n, b in contents.items()}
    heads = files.heads(spark, folder)
    name = lambda r: r.file_id.rpartition("/")[2].replace("%20", " ")
    found = {name(r): r for r in heads.collect()}
    assert {n: (r.file_size, bytes(r.head)) for n, r in found.items()} == {n: (len(b), b[:8]) for n, b in contents.items() if b}
    routed = {name(r): (r.format, r.mismatch) for r in files.route_heads(heads).collect()}
    assert routed == {
        "a b.csv": ("xlsx", True),
        "old.csv": ("xls", True),
        "real.xls": ("xls", False),
        "marked.csv": ("csv", False),
        "named.XLSX": ("xlsx", False),
        "short.csv": ("csv", False),
    }


def test_code_page_1251_there_and_back(spark):
    text = "".join(chr(b) for b in range(1, 128)) + bytes(b for b in range(128, 256) if b != 0x98).decode("cp1251")
    df = spark.createDataFrame([(text,), ("",), ("日本",)], "t string")
    fits = F.col("t"), files.fits_cp1251(F.col("t")).alias("fits")
    assert [r.fits for r in df.select(*fits).collect()] == [True, True, False]
    data = df.limit(1).select(files.to_cp1251(F.col("t")).alias("data"))
    row = data.select("data", files.from_cp1251(F.col("data")).alias("back")).first()
    assert (bytes(row["data"]), row.back) == (text.encode("cp1251"), text)
