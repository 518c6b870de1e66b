"""Histogram-sort sharding: shards of near-equal bytes from iteratively refined splitters.

The sort key of a row is (hash of its text, hash of its id, row number). Each round counts, in one
distributed aggregate, the exact bytes of the rows in every probe bin of the intervals that still
hold an unresolved boundary, and narrows each interval to one bin. A splitter is final when the
bytes below it are within `tolerance` of a shard of its target, or when its bin holds one row. Equal
texts share the first key part, so a boundary cuts a group of equal texts only if no boundary at
the edge of the group is within the tolerance. Only counts of bins reach the driver: at most
`fanout` for each of the `n_shards - 1` boundaries. The rows move once, to (shard, chunk), where
chunk splits a shard by hash into pieces of bounded row counts so that no task holds a whole shard.

Nulls: a null text has no bytes and the checksum 0; a null id sorts like any other value. Identical
rows are told apart by their row number. An empty table gives an empty result. Extra columns are
carried; columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import checkpointed, kept_columns, named, packed, unpacked

KEYS = ("_k1", "_k2", "_k3")
TOP = 1 << 62
ROW_OVERHEAD = 8
ROWS_A_CHUNK = 20_000


def _at_least(splitter: tuple[int, ...]) -> Column:
    """Whether the row's key is the splitter or above."""
    out = F.lit(True)
    for name, value in reversed(list(zip(KEYS, splitter, strict=False))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float = 0.005, fanout: int = 256) -> list[tuple[int, ...]]:
    """Splitter keys of the n_shards - 1 boundaries, ascending; keyed has _k1, _k2, _k3 and _size."""
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    if not total or n_shards < 2:
        return [(TOP,)] * (n_shards - 1)
    slack = tolerance * total / n_shards
    done: dict[int, tuple[int, ...]] = {}
    # an interval: keys before the level, lowest and highest value at the level, bytes below it, boundaries in it
    active = [((), 0, TOP - 1, 0, list(range(1, n_shards)))]
    while active:
        parts = []
        for i, (prefix, lo, hi, _, _) in enumerate(active):
            name, width = KEYS[len(prefix)], max(1, -(-(hi - lo + 1) // fanout))
            same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(KEYS, prefix, strict=False)], F.lit(True))
            parts.append(F.when(same & F.col(name).between(F.lit(lo), F.lit(hi)), F.lit(i * fanout) + F.expr(f"({name} - {lo}L) div {width}L")))
        aggregates = [F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n")]
        aggregates += [f(k).alias(f"{n}{k}") for k in KEYS for n, f in (("lo", F.min), ("hi", F.max))]
        binned = keyed.withColumn("_bin", F.coalesce(*parts)).where("_bin is not null").groupBy("_bin").agg(*aggregates).collect()
        bins: dict[int, list] = {}
        for row in sorted(binned, key=lambda r: r["_bin"]):
            bins.setdefault(row["_bin"] // fanout, []).append(row)
        following = []
        for i, (prefix, _, _, below, boundaries) in enumerate(active):
            k = KEYS[len(prefix)]
            for row in bins.get(i, []):
                after = below + row["bytes"]
                within = [j for j in boundaries if below <= total * j / n_shards < after]
                unresolved = []
                for j in within:
                    goal = total * j / n_shards
                    low = goal - below <= after - goal
                    if min(goal - below, after - goal) <= slack or row["n"] == 1:
                        done[j] = (*prefix, row[f"lo{k}"] if low else row[f"hi{k}"] + 1)
                    else:
                        unresolved.append(j)
                if unresolved and row[f"lo{k}"] == row[f"hi{k}"]:
                    fixed = (*prefix, row[f"lo{k}"])
                    nxt = KEYS[len(fixed)]
                    following.append((fixed, row[f"lo{nxt}"], row[f"hi{nxt}"], below, unresolved))
                elif unresolved:
                    following.append((prefix, row[f"lo{k}"], row[f"hi{k}"], below, unresolved))
                below = after
        active = following
    return [done.get(j, (TOP,)) for j in range(1, n_shards)]


def shard_by_bytes(df: DataFrame, n_shards: int = 24, text: str = "text", row_id: str = "doc_id", carry: list[str] | None = None, tolerance: float = 0.005) -> DataFrame:
    """df's columns (or those in `carry`) with size, text_crc32, law, shard, slot and grown_shard.

    slot numbers the rows of a shard from 0 without gaps. The input is checkpointed once with the
    carried columns, so row numbers stay what they are if an executor is lost.
    """
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    carry = kept_columns(df, carry, made)
    body = named(text)
    keyed = checkpointed(
        df.select(
            packed(carry),
            (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("_size"),
            F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("_crc"),
            F.shiftrightunsigned(F.xxhash64(body), 2).alias("_k1"),
            F.shiftrightunsigned(F.xxhash64(named(row_id)), 2).alias("_k2"),
            F.monotonically_increasing_id().alias("_k3"),
        )
    )
    splitters = find_splitters(keyed, n_shards, tolerance)
    shard = reduce(lambda a, b: a + b, [_at_least(s).cast("int") for s in splitters], F.lit(0))
    chunks = max(1, -(-keyed.count() // (ROWS_A_CHUNK * n_shards)))
    placed = keyed.withColumn("shard", shard).withColumn("_chunk", F.pmod(F.xxhash64(*KEYS), F.lit(chunks)).cast("int"))
    offsets = placed.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy(*KEYS)))
    return unpacked(
        numbered.join(offsets, ["shard", "_chunk"]),
        carry,
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("_offset") + F.col("_rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
