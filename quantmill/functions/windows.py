"""Row-position windows and the missing-value policies built on them.

Time is the row position ``pos`` of a key.  Frames that end at -1 exclude the current row.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

PAIR = ("symbol_y", "symbol_x")


def by(keys: tuple, order: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def prior(keys: tuple, n: int, order: str = "pos") -> WindowSpec:
    """The n rows before the current one."""
    return by(keys, order).rowsBetween(-n, -1)


def trail(keys: tuple, n: int, order: str = "pos") -> WindowSpec:
    """The n rows up to and including the current one."""
    return by(keys, order).rowsBetween(-(n - 1), 0)


def cum(keys: tuple, order: str = "pos") -> WindowSpec:
    return by(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def poison(value: Column, stat: Column, window: WindowSpec, n: int) -> Column:
    """``stat`` over the window, null unless all n values are known."""
    return F.when(F.count(value).over(window) == n, stat.over(window))


def latched_sum(value: Column, window: WindowSpec) -> Column:
    """Running sum that is null from the first null on."""
    unknown = F.max(value.isNull().cast("int")).over(window)
    return F.when(unknown == 0, F.sum(value).over(window))


def known_sum(value: Column) -> Column:
    """Sum of a group, null if any value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def near_zero(value: Column, scale: Column) -> Column:
    """Whether a denominator is too small against the largest value it was made of."""
    return F.abs(value) <= 1e-12 * F.greatest(F.lit(1.0), scale)


def ratio(top: Column, bottom: Column, scale: Column) -> Column:
    return F.when(~near_zero(bottom, scale), top / bottom)
