"""Ordered operators that need state along a sequence or a global rank: packing and ranking over split ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graph import cut


def greedy_pack(df: DataFrame, key: str, order: str, size: str, target: int) -> DataFrame:
    """Rows of each key dealt in order into groups: a new group starts when a row would pass the target and the group is not empty.

    Keys are sorted inside their partitions by Spark, which spills, and read as a stream; a task holds one batch and the state of one key.
    """
    rows = df.select(F.col(key).alias(key), F.col(order).alias(order), F.col(size).cast("long").alias(size))
    schema = StructType([*rows.schema.fields, StructField("pack", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pack, used = None, 0, 0
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = np.empty(len(keys), np.int64)
            for i, (k, n) in enumerate(zip(keys, sizes, strict=True)):
                if i == 0 and held is None or k != held:
                    held, pack, used = k, 0, 0
                if used > 0 and used + n > target:
                    pack, used = pack + 1, 0
                used += n
                out[i] = pack
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "pack"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def ranked(df: DataFrame, key: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with the rank (from 1) of each row among those of its key by the order, which must tell all rows apart.

    Rows are dealt to ranges of (key, order), so one key may span many tasks; ranks are places within a range plus the rows of the key in earlier ones.
    """
    sorted_ = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = cut(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = placed.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return met.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")).drop("_part", "_at", "_key", "_p", "_first", "_before")
