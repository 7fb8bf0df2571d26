"""Seeded order and draws from MD5 digests: the same under any partitioning, and in SQL.

Seeds give other orders than a Mersenne Twister would; every order is complete,
so results don't depend on ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw(n: Column, seed: int | str, *parts: Column) -> Column:
    """An integer from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("long"), n)


def uniform(seed: int | str, *parts: Column) -> Column:
    """Over (0, 1), from 52 bits."""
    return (F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
