"""Number parsing, rounding and single evaluation of shared expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Predicate pushdown substitutes column definitions into filters; an expression that
    mentions a regex result ten times would then run the regex ten times.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def where_known(df: DataFrame, found: dict[str, Column], known: list[str]) -> DataFrame:
    """Rows with the columns ``found``, where none of the ``known`` ones (or their fields) is null.

    A filter on a computed column is pushed below it and computes it a second time for every row; it is not
    pushed below a generator, here one of a single row.
    """
    one = F.explode(F.array(F.struct(*[value.alias(name) for name, value in found.items()])))
    rows = df.select("*", one.alias("_found")).where(
        reduce(lambda a, b: a & b, [F.col(f"_found.{name}").isNotNull() for name in known]))
    return rows.withColumns({name: F.col(f"_found.{name}") for name in found}).drop("_found")


def parse_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL, never NaN."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_decimal_comma(text: Column) -> Column:
    return parse_number(F.regexp_replace(text, ",", "."))


def r6(value: Column) -> Column:
    """Six decimals; a nudge far below them settles half-way cases alike on every engine."""
    return F.round(value + 3e-10, 6)


def bounded(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), value))
