"""Subscriptions of micro-snapshots: an append log with corrections, checked as a stream and as a batch.

A watermark that goes back is an error of that row, never a reason to drop it silently. Columns: subscription_id, sequence,
logical_id, generation, snapshot_id, watermark, prior_generation, prior_snapshot_id (the last two null without a correction).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ident import Names
from ..training import records

SNAPSHOT = "subscription_id string, sequence long, logical_id string, generation long, snapshot_id string, watermark long, prior_generation long, prior_snapshot_id string"
CHECKED = f"{SNAPSHOT}, violation string"


class _Checker(StatefulProcessor):
    """State of a subscription: its length and watermark, and one map entry for each logical id, so no row of state grows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._log = handle.getValueState("log", "length long, watermark long")
        self._latest = handle.getMapState("latest", "logical_id string", "generation long, snapshot_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([r.astype(object) for r in rows]).sort_values(["sequence", "snapshot_id"], kind="stable")
        log = self._log.get() if self._log.exists() else None
        length, watermark = (log[0], log[1]) if log else (0, None)
        verdicts = []
        for row in arrived.itertuples(index=False):
            known = self._latest.getValue((row.logical_id,)) if self._latest.containsKey((row.logical_id,)) else None
            verdict = _violation(row, length, watermark, known)
            if verdict is None:
                length, watermark = length + 1, int(row.watermark)
                self._latest.updateValue((row.logical_id,), (int(row.generation), row.snapshot_id))
            verdicts.append(verdict)
        if length:
            self._log.update((length, watermark))
        yield arrived.assign(violation=verdicts)

    def close(self) -> None:
        pass


def _violation(row, length: int, watermark: int | None, known) -> str | None:
    if row.sequence != length:
        return "sequence"
    if watermark is not None and row.watermark < watermark:
        return "watermark"
    corrects = not pd.isna(row.prior_generation) or row.prior_snapshot_id is not None
    if known is None:
        return "unknown-correction" if corrects else None if row.generation == 0 else "generation"
    fits = corrects and row.prior_generation == known[0] and row.prior_snapshot_id == known[1] and row.generation == known[0] + 1
    return None if fits else "generation"


def check_stream(snapshots: DataFrame) -> DataFrame:
    """Each arriving snapshot with its violation, null if it was appended. Rows of one trigger are taken by sequence.

    The session must use the RocksDB state store.
    """
    columns = [c.split()[0] for c in SNAPSHOT.split(", ")]
    return snapshots.select(*columns).groupBy("subscription_id").transformWithStateInPandas(
        statefulProcessor=_Checker(), outputStructType=CHECKED, outputMode="Append", timeMode="None")


def first_violations(snapshots: DataFrame) -> DataFrame:
    """The batch twin: sequence and kind of the first violation of each subscription that has one.

    Up to that row every row was appended, so windows over the whole log see what the stream's state holds.
    """
    log = Window.partitionBy("subscription_id").orderBy("sequence", "snapshot_id")
    chain = Window.partitionBy("subscription_id", "logical_id").orderBy("sequence", "snapshot_id")
    seen = (
        snapshots.withColumn("_at", F.row_number().over(log) - 1).withColumn("_mark", F.lag("watermark").over(log))
        .withColumn("_known", F.row_number().over(chain) > 1).withColumn("_g", F.lag("generation").over(chain)).withColumn("_s", F.lag("snapshot_id").over(chain))
    )
    corrects = F.expr("prior_generation is not null or prior_snapshot_id is not null")
    fits = F.coalesce(F.expr("prior_generation = _g and prior_snapshot_id = _s and generation = _g + 1"), F.lit(False))
    kind = (
        F.when(F.col("sequence") != F.col("_at"), "sequence").when(F.col("watermark") < F.col("_mark"), "watermark")
        .when(~F.col("_known") & corrects, "unknown-correction").when(~F.col("_known") & (F.col("generation") != 0), "generation").when(F.col("_known") & ~fits, "generation")
    )
    bad = seen.withColumn("violation", kind).where("violation is not null")
    return bad.groupBy("subscription_id").agg(F.min(F.struct("_at", "violation")).alias("v")).select("subscription_id", F.col("v._at").cast("long").alias("sequence"), F.col("v.violation").alias("violation"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest generation of each logical id of each subscription."""
    return snapshots.groupBy("subscription_id", "logical_id").agg(F.max("generation").alias("generation"), F.max_by("snapshot_id", "generation").alias("snapshot_id"))


def sealed(snapshots: DataFrame) -> DataFrame:
    """Subscriptions without a violation, their length and the newest watermark; only these count as evidence."""
    whole = snapshots.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("events"), F.max("watermark").alias("watermark"))
    return whole.join(first_violations(snapshots), "subscription_id", "left_anti")


def closed(snapshots: DataFrame, names: Names = Names()) -> DataFrame:
    """Subscriptions as sealed records: subscription_id, its identity and events, or the code of the fault that keeps it open.

    The id of a subscription here is any text; its content key is the SHA-256 of it. A record is one document of at most 16 MiB: a log that is larger
    is not gathered but is a resource-bound fault.
    """
    width = 420  # no event is longer
    sizes = snapshots.groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") * width > records.CATALOG_BYTES).select("subscription_id")
    small = snapshots.join(large, "subscription_id", "left_anti")
    key = lambda text: hashlib.sha256(str(text).encode()).hexdigest()

    def seal(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        events = []
        for r in rows.astype(object).sort_values("sequence", kind="stable").itertuples(index=False):
            corrects = not pd.isna(r.prior_generation) and r.prior_snapshot_id is not None
            correction = {"prior_generation": int(r.prior_generation), "prior_snapshot_id": key(r.prior_snapshot_id)} if corrects else None
            events.append({"correction": correction, "generation": int(r.generation), "logical_id": key(r.logical_id), "sequence": int(r.sequence), "snapshot_id": key(r.snapshot_id), "watermark": int(r.watermark)})
        try:
            made = records.close_subscription(key(name[0]), events, names)
            return pd.DataFrame({"subscription_id": [name[0]], "events": [len(events)], "identity": [records.subscription_id(made, names)], "code": [None]})
        except records.TrainingError as error:
            return pd.DataFrame({"subscription_id": [name[0]], "events": [len(events)], "identity": [None], "code": [error.code]})

    sealed_ = small.groupBy("subscription_id").applyInPandas(seal, "subscription_id string, events long, identity string, code string")
    return sealed_.unionByName(sizes.join(large, "subscription_id").select("subscription_id", F.col("n").alias("events"), F.lit(None).cast("string").alias("identity"), F.lit("resource-bound").alias("code")))
