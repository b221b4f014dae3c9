"""Statistics over array columns of doubles; an empty array gives null unless said otherwise. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def count_where(x: Column, test) -> Column:
    return F.size(F.filter(x, test))


def share(x: Column, test) -> Column:
    """The share of entries that pass a test; 0 for an empty array."""
    return F.coalesce(F.try_divide(count_where(x, test), F.size(x)), F.lit(0.0))


def variance(x: Column) -> Column:
    """Of the population; 0 for fewer than two entries."""
    m = mean(x)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return F.when(F.size(x) > 1, squares / F.size(x)).otherwise(F.lit(0.0))


def deviation(x: Column) -> Column:
    return F.sqrt(variance(x))


def median(x: Column) -> Column:
    s, n = F.array_sort(x), F.size(x)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2)


def last(x: Column, k: int) -> Column:
    """The last k entries, all if fewer."""
    return F.when(F.size(x) <= k, x).otherwise(F.slice(x, -k, k))


def slope(x: Column) -> Column:
    """Least squares over 0, 1, 2, ...; 0 for fewer than two entries."""
    n = F.size(x).cast("double")
    middle = (n - 1) / 2
    top = F.aggregate(F.transform(x, lambda v, i: (i - middle) * v), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(x) > 1, F.try_divide(top, n * (n * n - 1) / 12)).otherwise(F.lit(0.0))


def rising_mean(x: Column) -> Column:
    """Mean with weights 1, 2, ..., n."""
    n = F.size(x).cast("double")
    top = F.aggregate(F.transform(x, lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(top, n * (n + 1) / 2)


def without_one(x: Column, value: Column) -> Column:
    """x less one entry equal to value."""
    at = F.array_position(x, value).cast("int")
    return F.when(at > 0, F.concat(F.slice(x, F.lit(1), at - 1), F.slice(x, at + 1, F.size(x)))).otherwise(x)
