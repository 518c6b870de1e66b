"""Training catalogs as tables: faults of any number of snapshots and decision logs at once, and their sealed records.

Rows have snapshot, logical_id, group, split, label, payload, element, byte_order, shape and logical_bytes; labels have snapshot, logical_id,
concept, presence and payload (a struct of payload, element, byte_order, shape, logical_bytes); headers have snapshot, spec_id, profile, decision_log_id and dataset_roots.
A fault has the order of its test (ord), so the first fault of a snapshot is the least of (ord, key).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.ident import Names, canonical_json
from . import records

PAYLOAD = "struct<payload:string,element:string,byte_order:string,shape:array<long>,logical_bytes:long>"
ROWS = "snapshot string, logical_id string, group string, split string, label string, payload string, element string, byte_order string, shape array<long>, logical_bytes long"
LABELS = f"snapshot string, logical_id string, concept string, presence string, payload {PAYLOAD}"
HEADERS = "snapshot string, spec_id string, profile string, decision_log_id string, dataset_roots array<string>"


def _fault(rows: DataFrame, order: int, code: Column | str, key: str = "logical_id") -> DataFrame:
    return rows.select("snapshot", F.lit(order).alias("ord"), F.col(key).alias("key"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def payload_descriptors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Every payload as a row or label describes it."""
    of = ["payload", "element", "byte_order", "shape", "logical_bytes"]
    return rows.select("snapshot", "logical_id", *of).unionByName(labels.where("payload is not null").select("snapshot", "logical_id", "payload.*").select("snapshot", "logical_id", *of))


def snapshot_faults(headers: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """All faults of all snapshots: snapshot, ord, key and code."""
    extent = lambda df, order: _fault(df.withColumn("_fault", predicates.training_extent_fault(F.col("shape"), F.col("element"), F.col("byte_order"), F.col("logical_bytes"))).where("_fault is not null"), order, F.concat(F.lit("invalid-"), F.when(F.col("_fault") == "extent", "row-extent").otherwise(F.col("_fault"))))
    filled = rows.select("snapshot").distinct().withColumn("_rows", F.lit(True))
    empty = headers.join(filled, "snapshot", "left").where("_rows is null or size(dataset_roots) = 0").withColumn("key", F.lit(""))
    roots = headers.select("snapshot", F.explode("dataset_roots").alias("key")).groupBy("snapshot", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.groupBy("snapshot", "logical_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = labels.groupBy("snapshot", "logical_id", "concept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = labels.withColumn("key", F.concat_ws(" ", "logical_id", "concept"))
    known = rows.select("snapshot", "logical_id").distinct().withColumn("_row", F.lit(True))
    named = predicates.is_label_concept("concept")
    presence = predicates.presence_matches("presence", F.col("payload").isNotNull())
    told = F.when(F.col("payload").isNotNull(), predicates.training_extent_fault(F.col("payload.shape"), F.col("payload.element"), F.col("payload.byte_order"), F.col("payload.logical_bytes")))
    told = F.when(told == "extent", "invalid-row-extent").when(told == "byte-order", "invalid-byte-order")
    code = F.when(~named, "invalid-label-concept").when(F.col("_row").isNull(), "unknown-label-row").when(~presence, "invalid-label-presence").otherwise(told)
    judged = keyed.join(known, ["snapshot", "logical_id"], "left").withColumn("_code", code).where("_code is not null")
    conflicts = payload_descriptors(rows, labels).groupBy("snapshot", "payload").agg(F.count_distinct("element", "byte_order", "logical_bytes").alias("n")).where("n > 1")
    parts = [
        _fault(empty, 0, "invalid-snapshot", "key"), _fault(roots, 1, "duplicate-dataset-root", "key"), _fault(again, 2, "duplicate-logical-row"), extent(rows, 3),
        _fault(twice, 4, "duplicate-label-association"), _fault(judged, 5, F.col("_code"), "key"), _fault(conflicts, 6, "duplicate-payload", "payload"),
    ]
    return reduce(DataFrame.unionByName, parts)


def first_faults(faults: DataFrame) -> DataFrame:
    return faults.groupBy("snapshot").agg(F.min(F.struct("ord", "key", "code")).alias("f")).select("snapshot", "f.code", "f.key")


def closure_faults(rows: DataFrame, labels: DataFrame, frames: DataFrame, names: Names = Names()) -> DataFrame:
    """What keeps frames (snapshot, content_id, element, data) from being exactly the payloads of their snapshot: missing, then extra, then rows that do not fit."""
    from ..functions.ident import payload_id

    wanted = payload_descriptors(rows, labels)
    keys = wanted.select("snapshot", F.col("payload").alias("content_id")).distinct()
    held = frames.select("snapshot", "content_id").distinct()
    missing = _fault(keys.join(held, ["snapshot", "content_id"], "left_anti"), 0, "missing-payload", "content_id")
    extra = _fault(held.join(keys, ["snapshot", "content_id"], "left_anti"), 1, "extra-payload", "content_id")
    found = frames.select("snapshot", F.col("content_id").alias("payload"), F.col("element").alias("_element"), F.octet_length("data").alias("_size"), payload_id(F.col("element"), F.col("data"), names).alias("_id"))
    wrong = wanted.join(found, ["snapshot", "payload"]).where((F.col("element") != F.col("_element")) | (F.col("logical_bytes") != F.col("_size")) | (F.col("payload") != F.col("_id")))
    return reduce(DataFrame.unionByName, [missing, extra, _fault(wrong, 2, "invalid-row-extent")])


def seal_snapshots(headers: DataFrame, rows: DataFrame, labels: DataFrame, names: Names = Names()) -> DataFrame:
    """snapshot, code and key of its first fault, or snapshot_id and the canonical catalog.

    A catalog is one document of at most 16 MiB; a snapshot that would pass it is a resource-bound fault and its rows are not gathered.
    """
    faults = first_faults(snapshot_faults(headers, rows, labels))
    sizes = rows.groupBy("snapshot").agg(F.sum(F.size("shape") * 2 + 500).alias("n")).unionByName(labels.groupBy("snapshot").agg(F.sum(F.octet_length("concept") + 200).alias("n")))
    large = sizes.groupBy("snapshot").agg(F.sum("n").alias("n")).where(F.col("n") > records.CATALOG_BYTES).select("snapshot", F.lit("resource-bound").alias("code"), F.lit("").alias("key"))
    bad = faults.unionByName(large.join(faults, "snapshot", "left_anti"))
    header = headers.select("snapshot", F.lit("header").alias("part"), F.to_json(F.struct("spec_id", "profile", "decision_log_id", "dataset_roots")).alias("body"))
    fields = ["byte_order", "group", "label", "logical_bytes", "logical_id", "payload", "element", "shape", "split"]
    body = rows.select("snapshot", F.lit("row").alias("part"), F.to_json(F.struct(*fields)).alias("body"))
    label = labels.select("snapshot", F.lit("label").alias("part"), F.to_json(F.struct("concept", "logical_id", "payload", "presence"), {"ignoreNullFields": "false"}).alias("body"))
    good = header.unionByName(body).unionByName(label).join(bad.select("snapshot"), "snapshot", "left_anti")

    gathered = good.groupBy("snapshot").agg(*[F.collect_list(F.when(F.col("part") == part, F.col("body"))).alias(part) for part in ("header", "row", "label")])

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, header, body, label in batch.itertuples(index=False):
                h = json.loads(header[0])
                made = records.seal_snapshot(h["dataset_roots"], h["spec_id"], h["profile"], list(map(json.loads, body)), h["decision_log_id"], list(map(json.loads, label)), names)
                out.append((name, made))
            ids = records.identities(names, [(records.snapshot_domain(s), s) for _, s in out])
            yield pd.DataFrame({"snapshot": [n for n, _ in out], "snapshot_id": ids, "catalog": [canonical_json(s) for _, s in out]})

    sealed = gathered.mapInPandas(seal, "snapshot string, snapshot_id string, catalog string")
    null = F.lit(None).cast("string")
    return sealed.select("snapshot", null.alias("code"), null.alias("key"), "snapshot_id", "catalog").unionByName(bad.select("snapshot", "code", "key", null.alias("snapshot_id"), null.alias("catalog")))


def spec_identities(specs: DataFrame, names: Names = Names(), column: str = "spec") -> DataFrame:
    """The specifications (JSON) with spec_id and error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list = []
            for text in batch[column]:
                try:
                    made.append(records.normal_spec(json.loads(text)))
                except records.TrainingError as error:
                    made.append(error)
            good = [("spec-v1", m) for m in made if isinstance(m, dict)]
            ids = iter(records.identities(names, good))
            out = [(text, next(ids), None) if isinstance(m, dict) else (text, None, m.code) for text, m in zip(batch[column], made, strict=True)]
            yield pd.DataFrame(out, columns=[column, "spec_id", "error"])

    return specs.select(column).mapInPandas(rows, f"{column} string, spec_id string, error string")


def decision_faults(decisions: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The first fault of each decision log: log, place and code. decisions has log, place (from 0) and the members of a record.

    Tests of a record come in the order sequence, rank, durability, knob, barrier. Knobs that are not in allowed (log, knob) count only where nothing else is wrong.
    """
    before = Window.partitionBy("log").orderBy("place")
    code = (
        F.when(F.col("sequence") != F.col("place"), "invalid-decision-sequence").when(F.col("rank") != 0, "rank-not-zero").when(~F.col("durable_before_activation"), "decision-was-not-durable")
        .when(F.col("knob") == "", "invalid-adaptive-knob").when(F.col("activation_barrier") < F.lag("activation_barrier").over(before), "activation-barrier-regression")
    )
    judged = decisions.select("log", "place", "knob", code.alias("code"))
    faults = judged.where("code is not null").select("log", F.lit(0).alias("ord"), "place", "code")
    if allowed is not None:
        unknown = judged.join(allowed.select("log", "knob").distinct(), ["log", "knob"], "left_anti")
        faults = faults.unionByName(unknown.select("log", F.lit(1).alias("ord"), "place", F.lit("invalid-adaptive-knob").alias("code")))
    return faults.groupBy("log").agg(F.min(F.struct("ord", "place", "code")).alias("f")).select("log", F.col("f.place").alias("place"), F.col("f.code").alias("code"))


def replays(logs: DataFrame, replayed: DataFrame) -> DataFrame:
    """Whether each log was replayed exactly: log, records, and place of the first record that differs or is on one side only."""
    members = list(records.DECISION)
    side = lambda df, name: df.select("log", "place", F.struct(*members).alias(name))
    both = side(logs, "a").join(side(replayed, "b"), ["log", "place"], "full_outer")
    return both.groupBy("log").agg(F.count("a").alias("records"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("place"))).alias("differs_at"))


def equivalent(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows differ between two sources or are on one side only, with missing, extra or different."""
    columns = [c for c in first.columns if c not in key]
    a, b = first.select(*key, F.struct(*columns).alias("_a")), second.select(*key, F.struct(*columns).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return a.join(b, key, "full_outer").select(*key, state.alias("state")).where("state is not null")


def set_digest(df: DataFrame, key: list[str], value: Column, ident: str, width: int = 4096) -> DataFrame:
    """SHA-256 of the SHA-256 digests of consecutive id ranges of each key, in order: ids are whole numbers, a range holds `width` of them.

    No group is gathered whole: a range holds at most `width` ids, and the digests of the ranges are 64 bytes each.
    """
    ranges = df.withColumn("_range", F.floor(F.col(ident) / width))
    inner = ranges.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ident).alias("i"), value.alias("v")))), lambda x: x["v"]), ""), 256).alias("_digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "_digest"))), lambda x: x["_digest"]), "")
    return inner.groupBy(*key).agg(F.sum("_n").alias("n"), F.sha2(joined, 256).alias("digest"))


def execution_metrics(rows: DataFrame, plans: DataFrame, key: str = "snapshot", order: str = "logical_id", size: str = "logical_bytes") -> DataFrame:
    """For each snapshot and plan: rows, bytes, the look-ahead seen and the most bytes held by a queue that is filled as far ahead.

    Rows are summed in order within a snapshot; groups are packed by ordered.greedy_pack.
    """
    out = None
    for plan in plans.collect():
        ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, int(plan["prefetch"]))
        seen = rows.withColumn("_held", F.sum(size).over(ahead)).withColumn("_ahead", F.count(F.lit(1)).over(ahead) - 1)
        part = seen.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), F.sum(size).alias("bytes"), F.max("_ahead").alias("lookahead"), F.max("_held").alias("peak_bytes")).withColumn("profile", F.lit(plan["profile"]))
        part = part.withColumn("fits", (F.lit(plan["access"]) != "stream") | (F.col("peak_bytes") <= int(plan["cache_bytes"])))
        out = part if out is None else out.unionByName(part)
    return out
