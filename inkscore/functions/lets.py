"""Small helpers to compose higher-order functions without evaluating anything twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body`` with it.

    An expression captured inside a lambda is evaluated once per element, and
    Catalyst may inline a projected array into such a lambda. A lambda variable
    is only a reference, so the value is computed exactly once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_text(value: str) -> str:
    """A string as a SQL literal, for expressions over long word lists.

    Such an expression is handed over as one text; made of Columns it would cost
    a round trip to the JVM for every word.
    """
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Iterable[str]) -> str:
    return ", ".join(sql_text(v) for v in values)


def long_size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def total(array: Column, zero: Column | None = None) -> Column:
    """Sum of a numeric array, 0 when it is empty."""
    return F.aggregate(array, F.lit(0).cast("bigint") if zero is None else zero, lambda acc, x: acc + x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL instead of failing on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
