"""Statement date formats and calendar predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in tie-break order.
DATE_FORMATS = (
    "MM/dd/yyyy",
    "MM/dd/yy",
    "dd/MM/yyyy",
    "dd/MM/yy",
    "dd-MM-yyyy",
    "dd-MM-yy",
    "dd.MM.yyyy",
    "dd.MM.yy",
    "MM-dd-yyyy",
    "MM-dd-yy",
    "MM.dd.yyyy",
    "MM.dd.yy",
    "yyyy/MM/dd",
    "yy/MM/dd",
    "yyyy-MM-dd",
    "yy-MM-dd",
    "yyyy.MM.dd",
    "yyyyMMdd",
)


def date_part(c: Column) -> Column:
    """Text before the first white space or ``T``."""
    return F.split(c, r"[\sT]")[0]


def _shape(fmt: str) -> str:
    return "^" + re.sub(r"[A-Za-z]", lambda _: r"\d", fmt.replace(".", r"\.")) + "$"


def parse_date(c: Column, fmt: str) -> Column:
    """Strict parse of the date part; null when it does not fit ``fmt``.

    The digit shape is tested first, so texts of another layout never reach
    the formatter and its exception path. Two-digit years are 2000-based.
    """
    part = date_part(c)
    return F.when(part.rlike(_shape(fmt)), F.try_to_timestamp(part, F.lit(fmt)).cast("date"))


def has_date_shape(c: Column) -> Column:
    """Whether the date part has the digit shape of any known format."""
    shapes = dict.fromkeys(_shape(f) for f in DATE_FORMATS)
    return date_part(c).rlike("|".join(shapes))


def parse_date_by(c: Column, fmt: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Parse with a per-row format out of a known list."""
    return F.coalesce(*[F.when(fmt == f, parse_date(c, f)) for f in formats])


def is_first_weekday(date: Column, weekday: int) -> Column:
    """First such weekday of the month (Monday is 0)."""
    return (F.weekday(date) == weekday) & (F.dayofmonth(date) <= 7)


def is_last_weekday(date: Column, weekday: int) -> Column:
    return (F.weekday(date) == weekday) & (F.dayofmonth(date) > F.dayofmonth(F.last_day(date)) - 7)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def year_month(date: Column) -> list[Column]:
    return [F.year(date).alias("year"), F.month(date).alias("month")]
