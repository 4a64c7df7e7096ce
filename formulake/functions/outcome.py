"""Outcome text and numbers to percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import let


def as_percent(value: Column, keep_zero: bool = False) -> Column:
    """Fractions become percent; values outside (0, 100] (or [0, 100]) become NULL."""
    above = (value >= 0) if keep_zero else (value > 0)
    return F.when(above & (value <= 100), F.when((value > 0) & (value <= 1), value * 100).otherwise(value))


def clean_outcome(text: Column) -> Column:
    """Outcome text to percent: notes and error terms dropped, ranges to their midpoint."""
    trimmed = F.trim(text)
    # the patterns are asked only of texts that hold the sign each of them begins with
    noted = F.when(F.contains(trimmed, F.lit("(")), F.regexp_replace(trimmed, V.OUTCOME_NOTE, "")).otherwise(trimmed)
    bare = let(noted, lambda t: F.when(F.contains(t, F.lit("±")), F.regexp_replace(t, V.OUTCOME_ERROR, "")).otherwise(t))
    plain = F.translate(trimmed, "0123456789.", "") == ""

    def found(t, pattern, group):
        # no match is empty text, whose cast would throw and catch an exception in every row
        return F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("double")

    def number(t):
        ends = F.struct(found(t, V.OUTCOME_RANGE, 1).alias("low"), found(t, V.OUTCOME_RANGE, 2).alias("high"))
        return let(ends, lambda e: F.when(e["high"] > e["low"], (e["low"] + e["high"]) / 2).otherwise(
            found(t, r"([\d.]+)", 1)))

    known = text.isNotNull() & ~F.lower(trimmed).isin(V.MISSING_MARKS)
    value = F.when(plain, trimmed.try_cast("double")).otherwise(let(bare, number))
    return F.when(known, let(value, as_percent))


def naive_outcome(text: Column) -> Column:
    """The rule the recovery count is measured against: digits and dots only."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double")
