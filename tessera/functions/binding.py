"""Naming an expression's value, so that it is computed once where it is used often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being a lambda variable: inside another lambda it isn't computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def once(column: Column) -> Column:
    """The same value, for a select: a generator keeps the optimizer from copying a costly expression into each of its uses."""
    return F.explode(F.array(column))
