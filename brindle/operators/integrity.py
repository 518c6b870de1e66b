"""Referential, uniqueness, limit and containment rules as failure-row operators.

Every rule returns rows (rule, code, path, related): one row a violation. Rules are lazy, so a report over many rules
is one union that Spark plans as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure(df: DataFrame, rule: str, code: str, path: str, related: Column | str) -> DataFrame:
    related = F.col(related) if isinstance(related, str) else related
    return df.select(F.lit(rule).alias("rule"), F.lit(code).alias("code"), F.lit(path).alias("path"), related.cast("string").alias("related"))


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str, related: str | None = None) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_parent"), "left_anti").select("*" if related is None else related)


def repeated(df: DataFrame, identity: str, order: str) -> DataFrame:
    """All rows of an identity but its first by the order; a hot identity is joined to one row, not sorted."""
    first = df.groupBy(identity).agg(F.min(order).alias("_first")).select(F.col(identity).alias("_identity"), "_first")
    return df.join(first, F.col(identity) == F.col("_identity")).where(F.col(order) > F.col("_first")).drop("_identity", "_first")


def over_limit(df: DataFrame, group: list[str], most: int) -> DataFrame:
    """Groups that hold more rows than allowed; limits fail, they never truncate."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def unlisted_pairs(pairs: DataFrame, listed: DataFrame, on: list[str]) -> DataFrame:
    """Membership pairs that the owner does not list."""
    return pairs.join(listed.select(*on), on, "left_anti")


def all_agree(df: DataFrame, key: list[str], contract: Column, name: str = "agrees") -> DataFrame:
    """Whether every descriptor of a key satisfies the contract."""
    return df.groupBy(*key).agg(F.bool_and(contract).alias(name), F.count(F.lit(1)).alias("descriptors"))


def covers(child: str, parent: str) -> Column:
    """Whether a child's set column has everything its parent's set has."""
    return F.size(F.array_except(F.col(parent), F.col(child))) == 0


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)
