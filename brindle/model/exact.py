"""Exact numbers: reduced fractions of 128-bit integers, kept as strings in tables."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 127), (1 << 127) - 1
UNSIGNED = (1 << 64) - 1
RATIONAL = "struct<n: string, d: string>"


class ExactError(ValueError):
    pass


def integer(text: str) -> int:
    """A 128-bit integer from its digits, with an optional sign."""
    digits = text[1:] if text[:1] in ("-", "+") else text
    if not digits.isascii() or not digits.isdigit():
        raise ExactError("not an integer")
    value = int(text)
    if not LEAST <= value <= MOST:
        raise ExactError("integer is outside 128 bits")
    return value


def reduced(n: int, d: int) -> tuple[int, int]:
    """The fraction in lowest terms with a positive denominator."""
    if d == 0:
        raise ExactError("rational denominator is zero")
    if d == LEAST:
        raise ExactError("rational denominator is out of range")
    if n == 0:
        return 0, 1
    common = gcd(n, d)
    n, d = n // common, d // common
    if d < 0:
        n, d = -n, -d
    if n > MOST:
        raise ExactError("rational denominator is out of range")
    return n, d


def order(a: tuple[int, int], b: tuple[int, int]) -> int:
    left, right = a[0] * b[1], b[0] * a[1]
    return (left > right) - (left < right)


def sample_count(axis: dict) -> int | None:
    """Samples of a time axis, null where it is empty or their sum passes 64 bits."""
    if "regular" in axis:
        return axis["regular"]["samples"]
    if "piecewise" in axis:
        total = sum(s["samples"] for s in axis["piecewise"])
        return total if axis["piecewise"] and total <= UNSIGNED else None
    return axis["explicit"]["count"] or None


def is_positive(c: Column) -> Column:
    """Of a rational struct in lowest terms."""
    return ~c["n"].startswith("-") & (c["n"] != "0")


def is_negative(c: Column) -> Column:
    return c["n"].startswith("-")


def _orders(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for an, ad, bn, bd in parts:
        yield pd.Series([None if None in row else order((int(row[0]), int(row[1])), (int(row[2]), int(row[3]))) for row in zip(an, ad, bn, bd, strict=True)], dtype="Int32")


def rational_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as the rational struct a is below, equal to or above b; null if either is."""
    return F.pandas_udf(_orders, "int", F.PandasUDFType.SCALAR_ITER)(a["n"], a["d"], b["n"], b["d"])


def total_samples(segments: Column) -> Column:
    """Samples of an array of segment structs, null if there is none or the sum passes 64 bits."""
    total = F.aggregate(segments, F.lit(0).cast("decimal(38,0)"), lambda a, s: (a + s["samples"]).cast("decimal(38,0)"))
    return F.when((F.size(segments) > 0) & (total <= F.lit(str(UNSIGNED)).cast("decimal(38,0)")), total.cast("decimal(20,0)"))
