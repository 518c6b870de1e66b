"""The registry of container profiles: what roots each accepts, whether it is portable and whether it may refer to objects outside."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Root kinds by wire code.
ROOT_KINDS = {"dataset": 1, "recording": 2, "stream": 3, "atom": 4, "blob": 5, "bundle": 6}


class Profile(NamedTuple):
    code: int
    role: str
    roots: tuple[str, ...]
    portable: bool
    external: bool


#: The registered profiles.
PROFILES = {
    p.code: p
    for p in (
        Profile(0x10001, "lossless", ("dataset", "recording", "bundle"), True, False),
        Profile(0x20001, "progressive", ("dataset", "recording", "stream", "bundle"), True, False),
        Profile(0x30001, "balanced", ("dataset", "bundle"), False, True),
        Profile(0x30002, "compact", ("dataset", "bundle"), True, False),
        Profile(0x30003, "speed", ("dataset", "bundle"), False, True),
        Profile(0x30004, "memory", ("dataset", "bundle"), False, True),
        Profile(0x30005, "ultra-compact", ("dataset", "bundle"), True, False),
        Profile(0x30006, "training-stream", ("dataset", "bundle"), False, True),
        Profile(0x40001, "bounded-stream", ("stream", "bundle"), False, True),
        Profile(0x50001, "forensic-tree", ("dataset", "bundle"), True, False),
        Profile(0x50002, "forensic-image", ("blob", "bundle"), True, False),
    )
}
LOSSLESS, PROGRESSIVE, TREE, IMAGE = 0x10001, 0x20001, 0x50001, 0x50002


def accepts(code: int, root_kind: int) -> bool:
    return code in PROFILES and root_kind in [ROOT_KINDS[r] for r in PROFILES[code].roots]


def registry(spark: SparkSession) -> DataFrame:
    rows = [(p.code, p.role, [ROOT_KINDS[r] for r in p.roots], p.portable, p.external) for p in PROFILES.values()]
    return spark.createDataFrame(rows, "profile long, role string, root_kinds array<int>, portable boolean, external boolean")


def with_profile(containers: DataFrame, profile: str = "profile", root_kind: str = "root_kind") -> DataFrame:
    """Containers with the registered role of their profile and whether it is known and accepts their root; the registry is broadcast."""
    known = F.broadcast(registry(containers.sparkSession).withColumnRenamed("profile", "_profile"))
    met = containers.join(known, F.col(profile) == F.col("_profile"), "left").drop("_profile")
    accepted: Column = F.coalesce(F.array_contains("root_kinds", F.col(root_kind)), F.lit(False))
    return met.withColumn("accepted", accepted).drop("root_kinds")
