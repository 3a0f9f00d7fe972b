"""Delimited text: delimiter sniffing, record stitching, field splitting.

Input is ``lines(file_id, src_row, row_block, line)`` with text lines; row
blocks are bounded stretches of a file. Nothing here needs a whole file in one
place: a line's fields come from one regular expression, and quoted fields that
run over line ends are resolved from three flags per line, whose effects are
composed inside blocks of lines and then over a tree of blocks.

A full decode reads the text three times: ``line_table`` looks at each line once
and is stored; ``records`` then reads the text of single and of joined lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.indexing import block_of
from ledgerloom.session import materialize

# Candidates in tie-break order.
DELIMITERS = (";", "\t", ",")

_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` non-empty lines per file.

    Spark limits every task's partial ranking to ``n`` rows per file before
    the shuffle, so a large file costs no more than a small one.
    """
    order = W.partitionBy("file_id").orderBy("src_row")
    return lines.where("line <> ''").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)


def _outside_quotes(line: Column) -> Column:
    """The line without its quoted stretches; an open one runs to the end."""
    return F.regexp_replace(line, '"[^"]*(?:"|$)', "")


def _delimiter_counts(line: Column) -> Column:
    """How often each delimiter stands outside quotes; null for an empty line."""
    bare = _outside_quotes(line)
    counts = [(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).cast("int") for d in DELIMITERS]
    return F.when(line != "", F.array(*counts))


def line_table(lines: DataFrame) -> DataFrame:
    """The lines with all that delimiter and record search need of their text.

    ``_counts`` holds the delimiters outside quotes, ``_flags`` the quote flags
    for each delimiter the file may turn out to have. Stored once, it leaves
    the searches small columns to read.
    """
    flags = F.when(F.col("line").contains('"'), F.array(*[_quote_flags(F.col("line"), d) for d in DELIMITERS]))
    return lines.withColumn("_counts", _delimiter_counts(F.col("line"))).withColumn("_flags", flags)


def sniff_delimiters(lines: DataFrame, first: int | None = None) -> DataFrame:
    """Delimiter with the highest median count outside quotes; comma if none.

    All non-empty lines count, or only the ``first`` of each file. The median
    is exact and built from counts of counts, so it is combined map-side.
    """
    if "_counts" not in lines.columns:
        lines = lines.withColumn("_counts", _delimiter_counts(F.col("line")))
    lines = lines.where("_counts is not null") if first is None else first_lines(lines, first)
    counts = [F.percentile(F.get("_counts", F.lit(i)), F.lit(0.5)) for i in range(len(DELIMITERS))]
    medians = lines.groupBy("file_id").agg(*[c.alias(f"_m{i}") for i, c in enumerate(counts)])
    ranked = F.array_max(
        F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    )
    return medians.select("file_id", F.when(ranked["m"] > 0, ranked["d"]).otherwise(",").alias("delimiter"))


# ----------------------------------------------------------------- one record


def _fields(record: Column, d: str) -> Column:
    """Raw fields, each with a delimiter in front."""
    field = f'{d}(?:{_QUOTED}[^{d}]*|"[^"]*+(?:""[^"]*+)*+$|[^{d}]*)'
    return F.regexp_extract_all(F.concat(F.lit(d), record), F.lit(field), F.lit(0))


def _per_delimiter(delimiter: Column, build) -> Column:
    first, *rest = DELIMITERS
    case = F.when(delimiter == first, build(first))
    for d in rest:
        case = case.when(delimiter == d, build(d))
    return case


def _value(raw: Column) -> Column:
    """Field text: quotes removed, doubled quotes halved, stray text kept."""
    body = F.substring(raw, F.lit(2), F.length(raw))
    quoted = F.regexp_extract(body, f"(?s)^({_QUOTED})", 1)
    inside = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    after = F.substring(body, F.length(quoted) + 1, F.length(body))
    opened = F.substring(body, F.lit(2), F.length(body))
    undouble = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    return (
        F.when(quoted != "", F.concat(undouble(inside), after))
        .when(body.startswith('"'), undouble(opened))
        .otherwise(body)
    )


def split_record(record: Column, delimiter: Column) -> Column:
    """Cells of one record; a trailing delimiter yields an empty last cell."""
    return F.transform(_per_delimiter(delimiter, lambda d: _fields(record, d)), _value)


def _is_open(field: Column) -> Column:
    """The field starts with a quote that is not closed."""
    body = F.substring(field, F.lit(2), F.length(field))
    return body.startswith('"') & ~body.rlike(f"(?s)^{_QUOTED}")


def quote_problems(record: Column, delimiter: Column) -> Column:
    """Recovered quotes as ``array<struct<what, raw>>`` in field order.

    Every literal quote counts; ``raw`` is the field text read so far.
    """

    def problem(what: str, raw: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), raw.alias("raw"))

    def strays(before: Column, text: Column) -> Column:
        parts = F.split(text, '"')
        upto = lambda i: F.concat(before, F.array_join(F.slice(parts, F.lit(1), i), '"'))
        n = F.size(parts) - 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: problem("bare-quote", upto(i)))).otherwise(
            F.array().cast("array<struct<what:string,raw:string>>")
        )

    def one(field: Column) -> Column:
        body = F.substring(field, F.lit(2), F.length(field))
        quoted = F.regexp_extract(body, f"(?s)^({_QUOTED})", 1)
        tail = F.substring(body, F.length(quoted) + 1, F.length(body))
        inside = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit('""'), F.lit('"'))
        none = F.array().cast("array<struct<what:string,raw:string>>")
        return (
            F.when(_is_open(field), F.array(problem("unterminated-quote", _value(field))))
            .when(
                (quoted != "") & (tail != ""),
                F.concat(
                    F.array(problem("post-quote-garbage", F.concat(inside, F.substring(tail, 1, 1)))),
                    strays(inside, tail),
                ),
            )
            .when((quoted == "") & body.contains('"'), strays(F.lit(""), body))
            .otherwise(none)
        )

    return F.flatten(F.transform(_per_delimiter(delimiter, lambda d: _fields(record, d)), one))


# ------------------------------------------------------------ record stitching

STITCH_LINES = 4096
#: Blocks whose maps compose to one, on every level of the tree.
FAN = 256
_OPENS, _CLOSES, _REOPENS = 1, 2, 4


def _quote_flags(line: Column, d: str) -> Column:
    """Three facts of a line that decide how records run over line ends.

    opens: read from a record start, the line ends inside quotes.
    closes: the line holds a quote run of odd length, i.e. a closing one.
    reopens: read on behind that quote, the line ends inside quotes again.
    """
    open_end = f'(?:{d}(?:{_QUOTED}[^{d}]*+|(?!")[^{d}]*+))*+{d}"[^"]*+(?:""[^"]*+)*+$'
    opens = F.concat(F.lit(d), line).rlike(f"^{open_end}")
    closes = line.rlike(r'(?<!")"(?:"")*(?!")')
    reopens = line.rlike(f'^[^"]*+(?:""[^"]*+)*+"[^{d}]*+{open_end}')
    return opens.cast("int") * _OPENS + F.when(closes, _CLOSES + reopens.cast("int") * _REOPENS).otherwise(F.lit(0))


def _flag(lines: DataFrame) -> Column:
    if "_flags" in lines.columns:
        place = F.array_position(F.array(*map(F.lit, DELIMITERS)), F.col("delimiter")).cast("int")
        return F.coalesce(F.try_element_at("_flags", place), F.lit(0))
    flags = _per_delimiter(F.col("delimiter"), lambda d: _quote_flags(F.col("line"), d))
    return F.when(F.col("line").contains('"'), flags).otherwise(F.lit(0))


def _walked(lines: DataFrame) -> DataFrame:
    """What each line does to the state "inside quotes", in files where records may run on.

    ``(file_id, _block, src_row, _before, _after)``: the state in front of the line and
    behind it for both states at the block's start, as two-bit numbers (bit 0: from
    outside). A field only runs on where a closing line follows in its file. A
    line's own map sets the state, swaps it or keeps it, so the state follows
    from the last line of the block that sets it and the swaps since.
    """
    has = lambda bit: F.col("_flag").bitwiseAND(bit) > 0
    flags = lines.select("file_id", "src_row", _flag(lines).alias("_flag"))
    closing = F.max(F.when(has(_CLOSES), F.col("src_row")))
    suspects = flags.where("_flag > 0").groupBy("file_id").agg(F.bool_or(has(_OPENS)).alias("_any"), closing.alias("_last"))
    flags = flags.join(suspects.where("_any and _last is not null").drop("_any"), "file_id")
    followed = F.col("src_row") < F.col("_last")
    from_outside = has(_OPENS) & followed
    from_inside = ~has(_CLOSES) | (has(_REOPENS) & followed)
    lines = flags.select(
        "file_id",
        block_of(F.col("src_row"), STITCH_LINES).alias("_block"),
        "src_row",
        (from_outside == from_inside).alias("_sets"),
        (from_outside & ~from_inside).cast("int").alias("_swap"),
        from_inside.alias("_to"),
    )
    block = W.partitionBy("file_id", "_block").orderBy("src_row")
    swaps = F.sum("_swap").over(block)
    lines = lines.withColumn("_swaps", swaps)
    fixed = F.last(F.when(F.col("_sets"), F.struct(F.col("_to").alias("to"), F.col("_swaps").alias("at"))), ignorenulls=True).over(block)
    odd = lambda n: n % 2 == 1
    lines = lines.withColumn("_fixed", fixed)
    state = lambda entry: F.when(
        F.col("_fixed").isNotNull(), F.col("_fixed.to") != odd(F.col("_swaps") - F.col("_fixed.at"))
    ).otherwise(F.lit(entry) != odd(F.col("_swaps")))
    after = state(False).cast("int") + 2 * state(True).cast("int")
    lines = lines.withColumn("_after", after)
    before = F.coalesce(F.lag("_after").over(block), F.lit(2))
    return lines.select("file_id", "_block", "src_row", before.alias("_before"), "_after")


def _bit(code: Column, state: Column) -> Column:
    """The state a two-bit map leads to."""
    return F.when(state, code.bitwiseAND(2) > 0).otherwise(code.bitwiseAND(1) > 0)


def _block_maps(walked: DataFrame) -> DataFrame:
    """``(file_id, _block, code, start0, start1)``: a block's map, and its last record start from both states."""
    starts = lambda bit: F.max(F.when(F.col("_before").bitwiseAND(bit) == 0, F.col("src_row")))
    return walked.groupBy("file_id", "_block").agg(
        F.max_by("_after", "src_row").alias("code"), starts(1).alias("start0"), starts(2).alias("start1")
    )


def _entries(blocks: DataFrame, levels: int) -> DataFrame:
    """``(file_id, _block, state, start)`` in front of every block.

    The maps of ``FAN`` neighbouring blocks compose to the map of one block of
    the next level. At the top a file is one list of at most ``FAN`` maps; on the
    way down each list is walked from the state in front of it.
    """
    child = F.struct("_block", "code", "start0", "start1")
    lists = (
        blocks.withColumn("_over", F.floor(F.col("_block") / FAN).cast("long"))
        .groupBy("file_id", "_over")
        .agg(F.array_sort(F.collect_list(child)).alias("_list"))
    )

    def passed(acc: Column, c: Column) -> Column:
        """(state, start) behind a block."""
        start = F.coalesce(F.when(acc["state"], c["start1"]).otherwise(c["start0"]), acc["start"])
        return F.struct(_bit(c["code"], acc["state"]).alias("state"), start.alias("start"))

    nothing = F.lit(None).cast("long")
    if levels == 0:
        entered = lists.withColumn("state", F.lit(False)).withColumn("start", nothing)
    else:
        through = lambda state: F.aggregate("_list", F.struct(F.lit(state).alias("state"), nothing.alias("start")), passed)
        composed = lists.select("file_id", F.col("_over").alias("_block"), through(False).alias("a"), through(True).alias("b")).select(
            "file_id",
            "_block",
            (F.col("a.state").cast("int") + 2 * F.col("b.state").cast("int")).alias("code"),
            F.col("a.start").alias("start0"),
            F.col("b.start").alias("start1"),
        )
        entered = lists.join(_entries(composed, levels - 1).withColumnRenamed("_block", "_over"), ["file_id", "_over"])
    begun = F.struct(
        F.col("state").alias("state"),
        F.col("start").alias("start"),
        F.array().cast("array<struct<_block:bigint,state:boolean,start:bigint>>").alias("seen"),
    )

    def step(acc: Column, c: Column) -> Column:
        here = F.struct(c["_block"].alias("_block"), acc["state"].alias("state"), acc["start"].alias("start"))
        then = passed(acc, c)
        return F.struct(then["state"].alias("state"), then["start"].alias("start"), F.concat(acc["seen"], F.array(here)).alias("seen"))

    seen = entered.select("file_id", F.explode(F.aggregate("_list", begun, step)["seen"]).alias("_e"))
    return seen.select("file_id", "_e._block", "_e.state", "_e.start")


def continued_lines(lines: DataFrame) -> DataFrame:
    """``(file_id, src_row, record_row)`` of the lines in multi-line records.

    Only files with a line that ends inside quotes are looked at. Each block of
    lines is a map from the state in front of it to the state behind it; the
    maps compose over a tree of blocks (``_entries``), which gives the true
    state in front of every block and from it the record starts. No step has
    more than a block of lines, or ``FAN`` blocks, of a file in one place.
    """
    walked = materialize(_walked(lines), "walked")
    blocks = materialize(_block_maps(walked), "block-maps")
    last = blocks.agg(F.max("_block")).first()[0] or 0
    levels = 0
    while last >= FAN:
        last, levels = last // FAN, levels + 1
    inside = F.when(F.col("state"), F.col("_before").bitwiseAND(2) > 0).otherwise(F.col("_before").bitwiseAND(1) > 0)
    placed = walked.join(_entries(blocks, levels), ["file_id", "_block"]).withColumn("_inside", inside)
    block = W.partitionBy("file_id", "_block").orderBy("src_row")
    begins = F.last(F.when(~F.col("_inside"), F.col("src_row")), ignorenulls=True).over(block)
    placed = placed.select("file_id", "src_row", F.coalesce(begins, "start").alias("record_row"))
    own = F.struct("src_row", "record_row")
    head = F.struct(F.col("record_row").alias("src_row"), "record_row")
    both = placed.where("src_row <> record_row").select("file_id", F.explode(F.array(own, head)).alias("_r"))
    return both.select("file_id", "_r.*").distinct()


def records(lines: DataFrame) -> DataFrame:
    """Logical records ``(file_id, src_row, row_block, delimiter, record)``.

    ``lines`` must carry ``delimiter``; of a ``line_table`` the quote flags are
    used, else they are found in the text. Empty lines between records stay
    in, with an empty record; lines of one record are joined by a line feed.
    """
    multi = materialize(continued_lines(lines), "continued")
    kept = ["file_id", "src_row", "row_block", "delimiter"]
    single = lines.join(multi, ["file_id", "src_row"], "left_anti").select(*kept, F.col("line").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("src_row", "line")))
    joined = (
        lines.join(multi, ["file_id", "src_row"])
        .groupBy("file_id", "record_row", "delimiter")
        .agg(F.min("row_block").alias("row_block"), pieces.alias("p"))
        .select(
            "file_id",
            F.col("record_row").alias("src_row"),
            "row_block",
            "delimiter",
            F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("record"),
        )
    )
    return single.unionByName(joined)


def parse_records(found: DataFrame) -> DataFrame:
    """Cells and problems of every record, from one pass over the text.

    Empty lines get no cells and an ``empty-line`` problem.
    """
    record, delimiter = F.col("record"), F.col("delimiter")
    empty = F.array(F.struct(F.lit("empty-line").alias("what"), F.lit(None).cast("string").alias("raw")))
    problems = F.when(record == "", empty).when(record.contains('"'), quote_problems(record, delimiter))
    cells = F.when(record != "", split_record(record, delimiter))
    return found.select("file_id", "src_row", "row_block", cells.alias("cells"), problems.alias("problems"))


def record_issues(parsed: DataFrame) -> DataFrame:
    """Empty lines and recovered quotes."""
    action = F.when(F.col("p.what") == "empty-line", "skipped-row").otherwise("recovered-quote")
    return parsed.select("file_id", "src_row", F.explode("problems").alias("p")).select(
        "file_id",
        F.col("src_row").alias("row"),
        F.lit(None).cast("int").alias("column"),
        "p.what",
        "p.raw",
        action.alias("action"),
    )
