"""Dynamically typed SQL scalars.

A scalar is a struct: its kind and one field for each kind, so that values of any kind
can be grouped, compared and kept in one column.  A row is identified by the text of
its key, so the number 1 and the string '1' are the same row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALAR = "struct<k:string,s:string,n:double,b:boolean>"
Value = str | float | int | bool | None


def scalar(value: Value) -> dict:
    """The struct of a Python value."""
    if value is None:
        return {"k": "null", "s": None, "n": None, "b": None}
    if isinstance(value, bool):
        return {"k": "boolean", "s": None, "n": None, "b": value}
    if isinstance(value, (int, float)):
        return {"k": "number", "s": None, "n": float(value), "b": None}
    return {"k": "string", "s": value, "n": None, "b": None}


def value_of(struct) -> Value:
    """The Python value of a struct; numbers without fraction come as int."""
    if struct is None or struct["k"] == "null":
        return None
    if struct["k"] == "boolean":
        return struct["b"]
    if struct["k"] == "number":
        n = struct["n"]
        return int(n) if n == int(n) else n
    return struct["s"]


def number_text(x: float) -> str:
    """A number as its shortest decimal text: no fraction for whole numbers, exponents
    from 1e21 up and below 1e-6."""
    x = float(x)
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    if x < 0:
        return "-" + number_text(-x)
    mantissa, _, exponent = f"{x!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).rstrip("0") if fraction != "0" else whole.rstrip("0") or "0"
    point = len(whole) + int(exponent or 0)
    lead = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[lead:], point - lead
    if len(digits) <= point <= 21:
        return digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"0.{'0' * -point}{digits}"
    e = point - 1
    head = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "")
    return f"{head}e{'+' if e > 0 else '-'}{abs(e)}"


def key_text(key: str | float | int) -> str:
    """The identity of a row."""
    return key if isinstance(key, str) else number_text(key)


def make(kind: str, s: Column | None = None, n: Column | None = None, b: Column | None = None) -> Column:
    """A scalar struct from Columns."""
    null = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("k"), null(s, "string").alias("s"), null(n, "double").alias("n"), null(b, "boolean").alias("b"))


def of_string(c: Column) -> Column:
    return F.when(c.isNull(), make("null")).otherwise(make("string", s=c))


def of_number(c: Column) -> Column:
    return F.when(c.isNull(), make("null")).otherwise(make("number", n=c))


def of_boolean(c: Column) -> Column:
    return F.when(c.isNull(), make("null")).otherwise(make("boolean", b=c))


def literal(value: Value) -> Column:
    v = scalar(value)
    return make(v["k"], F.lit(v["s"]), F.lit(v["n"]), F.lit(v["b"]))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_as_text(n: Column) -> Column:
    """:func:`number_text` as a Column.  The digits are those of the JVM, which for a few
    numbers gives more than the shortest; whoever compares texts has to take both from here."""

    def digits(java: Column) -> Column:
        part = lambda i: F.regexp_extract(java, r"^(\d+)\.(\d+)(?:E(-?\d+))?$", i)
        exponent = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
        return F.struct(F.concat(part(1), part(2)).alias("every"), (F.length(part(1)) + exponent).alias("point"))

    def stripped(d: Column) -> Column:
        own = F.ltrim(F.rtrim(d["every"], F.lit("0")), F.lit("0"))
        lead = F.length(d["every"]) - F.length(F.ltrim(d["every"], F.lit("0")))
        return F.struct(own.alias("digits"), (d["point"] - lead).alias("point"), F.length(own).alias("size"))

    def text(x: Column) -> Column:
        d, point, size = x["digits"], x["point"], x["size"]  # places before the decimal point
        rest = F.when(size > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), size))).otherwise("")
        return (
            F.when((size <= point) & (point <= 21), F.rpad(d, point, F.lit("0")))
            .when((point > 0) & (point <= 21), F.concat(F.substring(d, F.lit(1), point), F.lit("."), F.substring(d, point + 1, size)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
            .otherwise(F.concat(F.substring(d, F.lit(1), F.lit(1)), rest, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string")))
        )

    whole = (n == F.floor(n)) & (F.abs(n) < F.lit(float(1 << 53)))
    endless = (F.abs(n) == F.lit(float("inf"))) | F.isnan(n)
    signed = F.concat(F.when(n < 0, "-").otherwise(""), bound(F.abs(n).cast("string"), lambda j: bound(digits(j), lambda d: bound(stripped(d), text))))
    return F.when(endless, n.cast("string")).when(whole, n.cast("bigint").cast("string")).otherwise(signed)


def text_of(c: Column) -> Column:
    """A scalar as text; null for the null scalar."""
    return F.when(c["k"] == "string", c["s"]).when(c["k"] == "number", number_as_text(c["n"])).when(c["k"] == "boolean", c["b"].cast("string"))


def fingerprint(c: Column) -> Column:
    """Kind and value as one text: equal for equal scalars only."""
    return F.concat_ws(":", c["k"], F.coalesce(text_of(c), F.lit("")))


def unwrap(c: Column, kind: str) -> Column:
    """The typed value of a scalar, null if it is of another kind."""
    field = {"string": "s", "number": "n", "boolean": "b"}[kind]
    return F.when(c["k"] == kind, c[field])
