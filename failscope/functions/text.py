"""Text rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(c: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clip(c: Column, limit: int = 160) -> Column:
    """Collapsed text of at most ``limit`` characters, the last one an ellipsis if it was cut."""
    flat = collapse(c)
    return shorten(flat, limit)


def shorten(c: Column, limit: int) -> Column:
    return F.when(F.char_length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - 1), F.lit("…")))


def clip_block(c: Column, limit: int) -> Column:
    """Trimmed text; what goes beyond ``limit`` characters is replaced by a note."""
    flat = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("\n… (truncated)")))


def around(c: Column, pattern: str, width: int = 70) -> Column:
    """The first match of ``pattern`` with half of ``width`` characters on both sides, collapsed."""
    at = F.regexp_instr(c, F.lit(pattern))
    size = F.char_length(F.regexp_substr(c, F.lit(pattern)))
    first = F.greatest(F.lit(1), at - width // 2)
    return collapse(F.substring(c, first, at + size + width // 2 - first))


def quoted(c: Column) -> Column:
    """A name in quotes: single ones, or double ones around a single quote."""
    return F.when(c.contains("'") & ~c.contains('"'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def general(c: Column) -> Column:
    """A double in its shortest form of six significant digits; large and small ones with an exponent."""
    padded = F.format_string("%.6g", c)
    return F.regexp_replace(F.regexp_replace(padded, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")


def two_places(c: Column | str) -> Column:
    """A number that isn't negative with two places: the nearest to its exact binary value, halves to even."""
    x = F.col(c) if isinstance(c, str) else c
    # 200 x in two parts without rounding, against the odd number in the middle of two hundredths
    high = x * 134217729.0 - (x * 134217729.0 - x)
    below = F.floor(x * 100)
    over = (high * 200 - (below * 2 + 1)) + (x - high) * 200
    hundredths = below + F.when((over > 0) | (over == 0) & (below % 2 == 1), 1).otherwise(0)
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
