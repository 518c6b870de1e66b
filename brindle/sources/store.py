"""An object store as tables: idempotent inserts, pins with whole closures, export, leases and collection; and a folder of files as such a store.

Objects have storage_id and content_id (the identity of what they mean; several storage ids may share one) and references; edges are (src, dst) of content ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ident import Names, payload_id
from ..operators import graph
from . import container as C


class StoreError(ValueError):
    pass


def new_objects(stored: DataFrame, arriving: DataFrame, key: str, order: str) -> DataFrame:
    """The arriving objects that are not stored yet, equal ones once (the first by order); appending them twice adds nothing."""
    columns = [c for c in arriving.columns if c != key]
    first = arriving.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*").select(*arriving.columns)
    return first.join(stored.select(key), key, "left_anti")


def incomplete(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose closure lacks an object: one walk back from all missing nodes, whatever the number of pins."""
    named = edges.select(F.col("dst").alias("node")).unionByName(edges.select(F.col("src").alias("node"))).distinct()
    missing = named.join(objects.select("node"), "node", "left_anti")
    return graph.reachable(missing, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("node")


def pinnable(pins: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """The pins (node), each with whether its closure is complete."""
    bad = incomplete(objects, edges).withColumn("_bad", F.lit(True))
    held = objects.select("node").distinct().withColumn("_held", F.lit(True))
    return pins.select("node").distinct().join(held, "node", "left").join(bad, "node", "left").select("node", (F.col("_held").isNotNull() & F.col("_bad").isNull()).alias("complete"))


def export_closure(pins: DataFrame, objects: DataFrame, edges: DataFrame) -> DataFrame:
    """The objects that the pins reach, themselves included."""
    return objects.join(graph.reachable(pins, edges).select("node"), "node", "left_semi")


def lease(descriptors: DataFrame, payloads: DataFrame, names: Names = Names()) -> DataFrame:
    """Descriptors (content_id, element, logical_bytes) with the bytes they name and a state: ok, missing, length or content.

    Bytes are given only where they have the length and the identity that the descriptor says.
    """
    held = payloads.groupBy("content_id").agg(F.min_by("data", F.octet_length("data")).alias("_data"))
    met = descriptors.join(held, "content_id", "left").withColumn("_id", payload_id(F.col("element"), F.col("_data"), names))
    state = F.when(F.col("_data").isNull(), "missing").when(F.octet_length("_data") != F.col("logical_bytes"), "length").when(F.col("_id") != F.col("content_id"), "content").otherwise("ok")
    return met.withColumn("state", state).withColumn("data", F.when(F.col("state") == "ok", F.col("_data"))).drop("_data", "_id")


def by_content(objects: DataFrame) -> DataFrame:
    """The object that a content id leads to: the one of the least storage id; and how many there are."""
    return objects.groupBy("content_id").agg(F.min("storage_id").alias("storage_id"), F.count_distinct("storage_id").alias("variants"))


def conflicting_closures(objects: DataFrame) -> DataFrame:
    """Content ids whose objects do not all have the same references."""
    return objects.groupBy("content_id").agg(F.count_distinct(F.array_join(F.array_sort(F.array_distinct("references")), ",")).alias("closures")).where("closures > 1")


def collectable(objects: DataFrame, pins: DataFrame, leased: DataFrame | None = None, on_broken_pin: str = "skip") -> DataFrame:
    """The objects that may be removed: no pin reaches their content, and no lease holds their storage.

    A pin whose closure lacks an object keeps nothing alive (skip), or fails the collection (fail).
    """
    if on_broken_pin not in ("skip", "fail"):
        raise ValueError("on_broken_pin is skip or fail")
    first = by_content(objects)
    edges = objects.join(first.select("storage_id"), "storage_id", "left_semi").select(F.col("content_id").alias("src"), F.explode("references").alias("dst"))
    nodes = first.select(F.col("content_id").alias("node"))
    judged = pinnable(pins.select("node"), nodes, edges)
    if on_broken_pin == "fail" and not judged.where("not complete").isEmpty():
        raise StoreError("the closure of a pin lacks an object")
    live = graph.reachable(judged.where("complete").select("node"), edges).select(F.col("node").alias("content_id"))
    dead = objects.join(live, "content_id", "left_anti")
    return dead if leased is None else dead.join(leased.select("storage_id"), "storage_id", "left_anti")


SUFFIX, UNFINISHED = ".object", ".tmp-"


def open_folder(spark: SparkSession, folder: str, fmt: C.Format, bounds: C.Bounds = C.Bounds()) -> DataFrame:
    """The objects of a folder: storage_id, content_id, references and payload ids, with the error of a file that does not verify or is not named by its storage id."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in batch.itertuples(index=False):
                name = path.rsplit("/", 1)[-1].removesuffix(SUFFIX)
                try:
                    found = C.parse(fmt, bytes(data), bounds)
                    error = None if found["storage_id"].hex() == name else "the name is not the storage id"
                    out.append((path, found["storage_id"].hex(), found["root_id"].hex(), [r.hex() for r in found["references"]], [f["content_id"].hex() for f in found["frames"]], error))
                except (ValueError, IndexError) as fault:
                    out.append((path, None, None, None, None, str(fault)))
            yield pd.DataFrame(out, columns=["path", "storage_id", "content_id", "references", "payloads", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")
    return files.mapInPandas(rows, "path string, storage_id string, content_id string, references array<string>, payloads array<string>, error string")


def publish(artifacts: DataFrame, folder: str, fmt: C.Format, bounds: C.Bounds = C.Bounds()) -> DataFrame:
    """Writes each artifact once under its storage id: storage_id, content_id and whether it was new. The folder is one that all executors share.

    A file is written under a name of its own and then linked, so a reader never sees half of it and writing it again changes nothing.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["artifact"]:
                found = C.parse(fmt, bytes(data), bounds)
                name = found["storage_id"].hex()
                unfinished = os.path.join(folder, f"{UNFINISHED}{name}-{os.getpid()}")
                with open(unfinished, "wb") as file:
                    file.write(bytes(data))
                    file.flush()
                    os.fsync(file.fileno())
                try:
                    os.link(unfinished, os.path.join(folder, name + SUFFIX))
                    new = True
                except FileExistsError:
                    new = False
                os.remove(unfinished)
                out.append((name, found["root_id"].hex(), new))
            yield pd.DataFrame(out, columns=["storage_id", "content_id", "new"])

    return artifacts.select("artifact").mapInPandas(rows, "storage_id string, content_id string, new boolean")


def clean_folder(folder: str) -> int:
    """Removes what interrupted writers left; returns how many files."""
    stale = [n for n in os.listdir(folder) if n.startswith(UNFINISHED)]
    for name in stale:
        os.remove(os.path.join(folder, name))
    return len(stale)


def remove_objects(folder: str, storage_ids: list[str]) -> None:
    for name in storage_ids:
        os.remove(os.path.join(folder, name + SUFFIX))


def import_portable(packs: DataFrame, fmt: C.Format, bounds: C.Bounds = C.Bounds()) -> DataFrame:
    """The files inside portable ones (artifact), embedded ones before their root: pack, nth, content_id and artifact; a pack that does not verify has its error and no files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["artifact"]:
                pack = fmt.storage_id(bytes(data)).hex()
                try:
                    out = [(pack, n, key.hex(), inner, None) for n, (key, inner) in enumerate(C.unpack(fmt, bytes(data), bounds))]
                except C.ContainerError as error:
                    out = [(pack, None, None, None, str(error))]
                yield pd.DataFrame(out, columns=["pack", "nth", "content_id", "artifact", "error"], dtype=object)

    return packs.select("artifact").mapInPandas(rows, "pack string, nth int, content_id string, artifact binary, error string")
