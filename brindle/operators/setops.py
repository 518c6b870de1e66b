"""Set and closure comparison operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with state missing or extra."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, key, "full_outer")
    return both.where("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("state"))


def zip_by_sequence(key: list[str], inputs: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of several inputs (table, order, value) paired by position within a key: key, seq, the values, and whole.

    whole is false for every row of a key whose inputs differ in length; such a key must fail as a whole, so none of its rows is dropped.
    """
    met = None
    for df, order, value in inputs:
        rows = df.select(*key, F.col(value).alias(value), (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).alias("seq"), F.lit(True).alias(f"_has_{value}"))
        met = rows if met is None else met.join(rows, [*key, "seq"], "full_outer")
    there = F.lit(True)
    for _, _, value in inputs:
        there = there & F.coalesce(F.col(f"_has_{value}"), F.lit(False))
    whole = F.bool_and(there).over(Window.partitionBy(*key))
    return met.withColumn("whole", whole).select(*key, "seq", *[v for _, _, v in inputs], "whole")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many rows each side has that the other has not, counting repeats."""
    only_left = left.exceptAll(right).agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("side"), "n")
    return only_left.unionByName(right.exceptAll(left).agg(F.count(F.lit(1)).alias("n")).select(F.lit("right").alias("side"), "n"))


def ordered_digest(value: Column, order: Column) -> Column:
    """SHA-256 of the values of a group joined in order; an aggregate for groups that fit in a row."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda x: x["v"]), ""), 256)


def conflicting(df: DataFrame, key: list[str], references: Column) -> DataFrame:
    """Keys whose variants do not all have the same set of references."""
    return df.groupBy(*key).agg(F.count_distinct(F.array_join(F.array_sort(references), ",")).alias("variants")).where("variants > 1")
