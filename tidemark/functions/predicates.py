"""Comparison of dynamically typed values, two-valued.

Values of one kind compare as usual, null equals null, and of values of different
kinds only ``!=`` holds.  A set (or a register with other than one value) contains a
literal (``=``) or does not (``!=``).  A column that a row has no cell for fails every
condition, ``!=`` too.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import Value, scalar

OPERATORS = ("=", "!=", "<", ">", "<=", ">=")
_APPLY = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
}
FIELDS = {"string": "s", "number": "n", "boolean": "b"}


def compare_scalar(actual: Column, op: str, value: Value, collation: str | None = None) -> Column:
    """``actual`` is a scalar struct; ``collation`` compares strings under that collation."""
    lit = scalar(value)
    mismatch = F.lit(op == "!=")
    if lit["k"] == "null":
        both = F.lit(op in ("=", "<=", ">="))
        return F.when(actual["k"] == "null", both).otherwise(mismatch)
    left, right = actual[FIELDS[lit["k"]]], F.lit(lit[FIELDS[lit["k"]]])
    if lit["k"] == "string" and collation:
        left, right = F.collate(left, collation), F.collate(right, collation)
    return F.when(actual["k"] == lit["k"], F.coalesce(_APPLY[op](left, right), mismatch)).otherwise(mismatch)


def compare_typed(actual: Column, kind: str, op: str, value: Value) -> Column:
    """``actual`` is a column of one kind; null is the null value."""
    lit = scalar(value)
    mismatch = F.lit(op == "!=")
    if lit["k"] == "null":
        return F.when(actual.isNull(), F.lit(op in ("=", "<=", ">="))).otherwise(mismatch)
    if lit["k"] != kind:
        return mismatch
    return F.coalesce(_APPLY[op](actual, F.lit(lit[FIELDS[kind]])), mismatch)


def same(a: Column, value: Value) -> Column:
    """A scalar struct equals a literal, kind and value."""
    lit = scalar(value)
    if lit["k"] == "null":
        return a["k"] == "null"
    return F.coalesce((a["k"] == lit["k"]) & (a[FIELDS[lit["k"]]] == F.lit(lit[FIELDS[lit["k"]]])), F.lit(False))


def compare_array(actual: Column, op: str, value: Value) -> Column:
    """``actual`` is an array of scalar structs."""
    if op not in ("=", "!="):
        return F.lit(False)
    held = F.coalesce(F.exists(actual, lambda x: same(x, value)), F.lit(False))
    return held if op == "=" else ~held


def compare_register(actual: Column, op: str, value: Value, collation: str | None = None) -> Column:
    """A register is its value if it has one, else an array."""
    return F.when(F.size(actual) == 1, compare_scalar(F.element_at(actual, 1), op, value, collation)).otherwise(compare_array(actual, op, value))


def guarded(present: Column, condition: Column) -> Column:
    return F.when(F.coalesce(present, F.lit(False)), F.coalesce(condition, F.lit(False))).otherwise(F.lit(False))


def every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
