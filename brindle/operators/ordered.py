"""Ordered-sequence operators: logs, chains, packing, look-ahead and extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_violation(df: DataFrame, key: list[str], position: str, tests: list[tuple[str, Column]]) -> DataFrame:
    """The first violation of each sequence by position, tests in the given order."""
    kind = F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests])
    bad = df.withColumn("violation", kind).where("violation is not null")
    return bad.groupBy(*key).agg(F.min(F.struct(position, "violation")).alias("v")).select(*key, F.col(f"v.{position}").alias(position), F.col("v.violation").alias("violation"))


def sequence_position(key: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1


def previous(column: str, key: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*key).orderBy(*order))


def generation_chain(events: DataFrame, key: str, sequence: str) -> DataFrame:
    """generation and prior of each event of a key: the position in the key's chain and the event it corrects."""
    w = Window.partitionBy(key).orderBy(sequence)
    return events.withColumn("generation", F.row_number().over(w) - 1).withColumn("prior", F.lag(sequence).over(w))


def fixed_groups(df: DataFrame, key: str, order: str, rows: int) -> DataFrame:
    return df.withColumn("pack", F.expr(f"(row_number() over (partition by {key} order by {order}) - 1) div {rows}"))


def lookahead(key: str, order: str, n: int) -> Column:
    """How many of the next n rows there are."""
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(order).rowsBetween(1, n))


def queued_bytes(key: str, order: str, size: str, n: int) -> Column:
    """Bytes held when a row is taken from a queue filled n rows ahead."""
    return F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(0, n))


def running_offset(key: str, order: str, size: str) -> Column:
    return F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def broken_extents(df: DataFrame, key: str, offset: str, length: str) -> DataFrame:
    """Rows whose extent does not begin where the one before it ended; expected is 0 for the first."""
    w = Window.partitionBy(key).orderBy(offset)
    return df.withColumn("expected", F.coalesce(F.lag(F.col(offset) + F.col(length)).over(w), F.lit(0))).where(F.col(offset) != F.col("expected"))
