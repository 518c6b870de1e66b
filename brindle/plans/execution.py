"""The six default execution plans, their ranges and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
#: Profile, row group rows, row group bytes, prefetch, access, cache bytes, external references allowed.
DEFAULT_PLANS = (
    ("balanced", None, 16 * MIB, 16, "prefer-mmap", 256 * MIB, True),
    ("compact", None, 8 * MIB, 4, "materialize", 128 * MIB, False),
    ("memory", 1, None, 1, "prefer-mmap", 32 * MIB, True),
    ("speed", None, 64 * MIB, 64, "require-mmap", GIB, True),
    ("stream", 1, None, 2, "stream", 8 * MIB, True),
    ("ultra-compact", None, 64 * MIB, 0, "stream", 16 * MIB, False),
)
#: Profiles whose closure must be portable.
PORTABLE = ("compact", "ultra-compact")
SCHEMA = "profile string, group_rows long, group_bytes long, prefetch long, access string, cache_bytes long, external boolean"
VALID = f"""(group_rows is null or group_rows between 1 and 65536)
    and (group_bytes is null or group_bytes between {4 * KIB} and {GIB})
    and (prefetch = 0 or prefetch between 1 and 4096) and cache_bytes between 0 and {16 * GIB}
    and (access <> 'materialize' or cache_bytes > 0) and not (external and profile in {PORTABLE})"""


def default_plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_PLANS), SCHEMA)


def compile_plan(profile: str, **overrides: object) -> dict:
    """The plan of a profile with overrides, checked against the ranges."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    plan = next((dict(zip(names, p, strict=True)) for p in DEFAULT_PLANS if p[0] == profile), None)
    if plan is None:
        raise ValueError(f"unknown profile {profile}")
    if unknown := set(overrides) - set(names[1:]):
        raise ValueError(f"unknown plan fields {sorted(unknown)}")
    plan |= overrides
    rows, size = plan["group_rows"], plan["group_bytes"]
    if (rows is None) == (size is None):
        raise ValueError("a plan groups by rows or by bytes")
    if rows is not None and not 1 <= rows <= 65536 or size is not None and not 4 * KIB <= size <= GIB:
        raise ValueError("row group out of range")
    if not (plan["prefetch"] == 0 or 1 <= plan["prefetch"] <= 4096) or not 0 <= plan["cache_bytes"] <= 16 * GIB:
        raise ValueError("prefetch or cache out of range")
    if plan["external"] and profile in PORTABLE:
        raise ValueError("a portable profile refers to nothing outside")
    if plan["access"] == "materialize" and not plan["cache_bytes"]:
        raise ValueError("materialize needs a cache")
    return plan
