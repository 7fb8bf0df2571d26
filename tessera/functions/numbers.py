"""Figures in text, each with the set of values it may stand for.

A value is written as its digits without leading or trailing zeros, `e`, and a
power of ten: every multiplier and the percent sign only move the decimal point,
so no figure is too long to be exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lexicon import CURRENCY, FLAGS

# Names with digits that are no figures.
NAMED = FLAGS + r"\b\d{3}\s?\(\s?[a-z]\s?\)|\b40[13]k\b|S&P\s?\d+|\b1099(?:-[A-Za-z]+)?\b|\b(?:form|schedule)\s+\d+\w*"
# The power of ten of each multiplier.
MULTIPLIERS = {"thousand": 3, "million": 6, "billion": 9, "trillion": 12, "mm": 6, "bn": 9, "k": 3, "m": 6, "b": 9}
# Bare integers up to the first, and from the second to the third, are list numbers and years.
SMALL, FIRST_YEAR, LAST_YEAR = 10, 1900, 2099

# The form of a figure, and what may not stand beside it.
BODY = (
    rf"({CURRENCY}\s?)?((?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?|\.\d+)"
    rf"(?:\s?({'|'.join(MULTIPLIERS)})(?!\w))?(\s?%|\s?percent(?!\w))?"
)
FIGURE = FLAGS + r"(?<![\w.])(?<![A-Za-z]-)" + BODY + r"(?!\w)"
WHOLE = FLAGS + "^" + BODY + "$"


def _value(digits: Column, power: Column) -> Column:
    kept = F.rtrim(digits, F.lit("0"))
    return F.when(kept == "", F.lit("0")).otherwise(F.concat_ws("e", kept, (power + F.length(digits) - F.length(kept)).cast("string")))


def _figure(match: Column) -> Column:
    part = lambda k: F.regexp_extract(match, WHOLE, k)
    number = F.regexp_replace(part(2), ",", "")
    places = F.when(F.instr(number, ".") > 0, F.length(F.substring_index(number, ".", -1))).otherwise(0)
    digits = F.ltrim(F.regexp_replace(number, r"\.", ""), F.lit("0"))
    multiplier, percent = F.lower(part(3)), part(4) != ""
    power = F.coalesce(F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])[multiplier], F.lit(0))
    values = F.array_distinct(
        F.array_compact(
            F.array(
                _value(digits, -places),
                F.when(multiplier != "", _value(digits, power - places)),
                F.when(percent, _value(digits, -places - 2)),
            )
        )
    )
    plain = (part(1) == "") & (multiplier == "") & ~percent & ~part(2).contains(".") & ~part(2).contains(",")
    small = F.when(F.length(digits) <= 4, F.coalesce(digits.try_cast("int"), F.lit(0)))
    exempt = plain & F.coalesce((small <= SMALL) | small.between(FIRST_YEAR, LAST_YEAR), F.lit(False))
    return F.struct(F.trim(match).alias("text"), values.alias("values"), exempt.alias("exempt"))


def figures(text: Column) -> Column:
    """array<struct<text, values, exempt>> in order."""
    cleared = F.regexp_replace(text, NAMED, " ")
    return F.transform(F.regexp_extract_all(cleared, F.lit(FIGURE), F.lit(0)), _figure)


def all_values(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found, lambda f: f["values"])))
