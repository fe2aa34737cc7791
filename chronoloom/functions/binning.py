"""Bins of the unit interval with exact double edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(bins: int) -> list[float]:
    """The bins + 1 edges i * (1 / bins); some differ from the decimal in the last place, and that decides."""
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def _above(x: Column, bins: int, test) -> Column:
    return reduce(lambda a, b: a + b, [test(x, F.lit(e)).cast("int") for e in edges(bins)[1:-1]], F.lit(0))


def half_open_bin(x: Column, bins: int = 10) -> Column:
    """Bin of [lo, hi); the last one holds its upper edge too. Null stays null."""
    return _above(x, bins, lambda a, e: a >= e)


def right_closed_bin(x: Column, bins: int = 10) -> Column:
    """Bin of (lo, hi]; the first one holds 0 too. Null outside of [0, 1]."""
    return F.when((x >= 0) & (x <= 1), _above(x, bins, lambda a, e: a > e))


def edges_sql(x: str, bins: int, sign: str) -> str:
    """The same count of edges in SQL."""
    return "(" + " + ".join(f"CAST({x} {sign} {e!r}::DOUBLE AS INTEGER)" for e in edges(bins)[1:-1]) + ")"
