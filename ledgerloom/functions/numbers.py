"""Locale-tolerant number parsing as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let, trimmed

_READABLE = r"^-?[\d\s\u00a0\u2000-\u200a\u202f,.']*$"
_PREFIX = r"^-?(?:\d+\.?\d*|\.\d+)"


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _from_end(c: Column, char: str) -> Column:
    """Distance of the last ``char`` from the end; large when absent."""
    at = F.instr(F.reverse(c), char)
    return F.when(at == 0, F.length(c) + 1).otherwise(at)


def parse_number(c: Column) -> Column:
    """Text to double; null where the text is not a number.

    One leading plus is allowed. Two or more dots make the comma the decimal
    mark, two or more commas make it the dot, otherwise the later of the two
    wins (a lone comma is a decimal comma). Blanks and apostrophes group
    digits. A minus sign inside the number makes it unreadable; the number ends
    at the first character that cannot belong to it.
    """

    def unsigned(plain: Column) -> Column:
        return F.when(plain.startswith("+"), F.substring(plain, F.lit(2), F.length(plain))).otherwise(plain)

    def number(dotted: Column) -> Column:
        prefix = F.regexp_extract(dotted, _PREFIX, 0)
        return F.coalesce(dotted.try_cast("double"), prefix.try_cast("double"))

    def value(text: Column) -> Column:
        comma_decimal = (
            F.when(_count(text, ".") > 1, F.lit(True))
            .when(_count(text, ",") > 1, F.lit(False))
            .otherwise(_from_end(text, ",") <= _from_end(text, "."))
        )
        # translate drops the characters that have no counterpart.
        dotted = F.when(comma_decimal, F.translate(text, ",.' ", ".")).otherwise(F.translate(text, ",' ", ""))
        return F.when(text.rlike(_READABLE), let(dotted, number))

    # each step is bound once: every use of it would compute it again
    return let(let(trimmed(c), unsigned), value)
