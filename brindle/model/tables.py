"""Dataset documents as tables: one row a document, and one table for each collection.

Documents are read once, in parallel, each in one task (a document must fit in a row). The rows of a collection keep their place (idx) and the
key of their document (dataset, by default its path), so thousands of documents are checked by one job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ident import Names
from . import document as doc

RATIONAL = "struct<n:string,d:string>"
NUMBER = "struct<tag:string,n:string,d:string>"
U64 = "decimal(20,0)"
KEYS = "array<struct<namespace:string,value:string>>"
REFERENCE = "struct<kind:string,id:string>"
SEGMENTS = f"array<struct<start:{RATIONAL},rate:{RATIONAL},samples:{U64}>>"
COLUMNS = "array<struct<semantic:string,element:string,nullable:boolean>>"
LAYOUT = f"struct<tag:string,rows:{U64},nonzero:{U64},block_len:long,mantissa_bits:int,offsets:string,indices:string,indptr:string,scales:string>"
PAYLOAD = f"struct<content_id:string,logical_bytes:{U64},element:string,byte_order:string,shape:array<{U64}>,layout:{LAYOUT},encoding:string,media_type:string>"
CATALOG = f"id:string,kind:string,source_keys:{KEYS}"
#: The fields of each collection beside dataset and idx.
SCHEMAS = {
    **dict.fromkeys(("subjects", "patients", "sessions", "acquisitions", "devices", "sensors", "channels", "concept_dictionaries"), CATALOG),
    "source_relationships": "kind:string,from_id:string,to_id:string,position:long",
    "recordings": f"id:string,streams:array<string>,source_keys:{KEYS}",
    "streams": "id:string,recording_id:string,modality:string,atoms:array<string>,clock_id:string,channel_basis_id:string,policy_id:string",
    "atoms": f"id:string,kind:string,presence:string,payload:{PAYLOAD},calibration:struct<scale:{RATIONAL},offset:{RATIONAL},unit:string>,"
    f"time_axis:struct<tag:string,segments:{SEGMENTS},timestamps:string,count:{U64}>,clock_id:string,record_kind:string,columns:{COLUMNS},"
    f"axes:array<struct<semantic:string,extent:{U64}>>,decoded_semantics:struct<atom_kind:string,element:string,shape:array<{U64}>>,media_type:string,integrity:struct<algorithm:string,digest:string>",
    "clocks": f"id:string,kind:string,parent_id:string,offset:{RATIONAL},rate:{RATIONAL},uncertainty:{RATIONAL}",
    "coordinate_frames": f"id:string,kind:string,parent_id:string,transform:array<{NUMBER}>,uncertainty:{RATIONAL}",
    "channel_bases": f"id:string,reference:string,channels:array<struct<concept:string,coordinate_frame_id:string,source_keys:{KEYS}>>",
    "clock_relations": f"id:string,from_clock_id:string,to_clock_id:string,offset:{RATIONAL},rate:{RATIONAL},uncertainty:{RATIONAL},method:string,validity_start:{RATIONAL},validity_end:{RATIONAL},provenance:string",
    "frame_transforms": f"id:string,from_frame_id:string,to_frame_id:string,transform:array<{NUMBER}>,uncertainty:{RATIONAL},method:string",
    "events": f"id:string,kind:string,clock_id:string,start:{RATIONAL},end:{RATIONAL},uncertainty:{RATIONAL}",
    "derived_artifacts": "id:string,content_id:string,derivation_id:string",
    "policies": "id:string,parent_id:string,restrictions:array<string>",
    "proofs": f"id:string,kind:string,subject:{REFERENCE},payload:string",
    "derivations": f"id:string,operation:string,inputs:array<{REFERENCE}>,outputs:array<{REFERENCE}>",
    "fidelity": f"subject:{REFERENCE},kind:string,metric:string,bound:{NUMBER}",
    "source_capsules": "source:struct<namespace:string,value:string>,content_id:string,media_type:string",
    "observed_execution": "operation:string,implementation:string,hardware:string",
}


def _flat(value: object) -> object:
    """Tagged objects as structs with a tag."""
    if isinstance(value, list):
        return [_flat(v) for v in value]
    if not isinstance(value, dict):
        return value
    if "$rational" in value:
        return {"tag": "rational", "n": value["$rational"][0], "d": value["$rational"][1]}
    if "$integer" in value:
        return {"tag": "integer", "n": value["$integer"], "d": "1"}
    return {k: _flat(v) for k, v in value.items()}


def _row(collection: str, record: dict) -> dict:
    """A record as a row of its table."""
    row = _flat(record)
    if collection == "source_relationships":
        a, b = doc.RELATIONSHIPS[record["kind"]]
        return {"kind": record["kind"], "from_id": record[a], "to_id": record[b], "position": record.get("position")}
    if collection == "atoms":
        if row["payload"]:
            layout = row["payload"]["layout"]
            row["payload"]["layout"] = {"tag": layout} if isinstance(layout, str) else {"tag": next(iter(layout)), **next(iter(layout.values()))}
        if "time_axis" in row:
            (tag, axis), = row["time_axis"].items()
            row["time_axis"] = {"tag": tag, **(axis if tag == "explicit" else {"segments": axis if tag == "piecewise" else [axis]})}
    return row


def read_documents(files: DataFrame, names: Names = Names(), key: str = "path", content: str = "content") -> DataFrame:
    """One row a file: dataset, dataset_id, document (debug JSON), is_canonical, logical_id, interchange_id, or error_path and error_message."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, read = [], []
            for name, data in batch.itertuples(index=False):
                row = dict.fromkeys(("dataset", "dataset_id", "document", "is_canonical", "logical_id", "interchange_id", "error_path", "error_message")) | {"dataset": str(name)}
                try:
                    found = doc.read(b"" if data is None else data.encode() if isinstance(data, str) else bytes(data))
                    row |= {"dataset_id": found["dataset_id"], "document": doc.debug_json(found), "is_canonical": doc.is_canonical(data.encode() if isinstance(data, str) else bytes(data), found)}
                    read.append((row, found))
                except doc.DocumentError as error:
                    row |= {"error_path": error.path, "error_message": error.message}
                out.append(row)
            for projection in doc.DOMAINS:
                for (row, _), identity in zip(read, doc.identities([d for _, d in read], projection, names), strict=True):
                    row[f"{projection}_id"] = identity
            yield pd.DataFrame(out, dtype=object)

    schema = "dataset string, dataset_id string, document string, is_canonical boolean, logical_id string, interchange_id string, error_path string, error_message string"
    return files.select(key, content).mapInPandas(rows, schema)


def records(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """dataset, collection, idx and body (JSON of the row) of every record of every document that reads."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in batch.itertuples(index=False):
                try:
                    found = doc.read(b"" if data is None else data.encode() if isinstance(data, str) else bytes(data))
                except doc.DocumentError:
                    continue
                out = [(str(name), "datasets", 0, json.dumps({"id": found["dataset_id"]}))]
                out += [(str(name), c, i, json.dumps(_row(c, r))) for c in doc.COLLECTIONS for i, r in enumerate(found[c])]
                yield pd.DataFrame(out, columns=["dataset", "collection", "idx", "body"])

    return files.select(key, content).mapInPandas(rows, "dataset string, collection string, idx long, body string")


def collections(found: DataFrame) -> dict[str, DataFrame]:
    """The table of each collection from records(); keep `found` where many tables are read."""
    out = {"datasets": found.where("collection = 'datasets'").select("dataset", F.from_json("body", "struct<id:string>").alias("r")).select("dataset", "r.*")}
    for name, fields in SCHEMAS.items():
        out[name] = found.where(F.col("collection") == name).select("dataset", "idx", F.from_json("body", f"struct<{fields}>").alias("r")).select("dataset", "idx", "r.*")
    return out


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables without rows, for callers that fill some of them."""
    none = {name: spark.createDataFrame([], _ddl(fields)) for name, fields in SCHEMAS.items()}
    return {"datasets": spark.createDataFrame([], "dataset string, id string"), **none}


def _ddl(fields: str) -> str:
    return f"struct<dataset:string,idx:long,{fields}>"


def family_counts(t: dict[str, DataFrame]) -> DataFrame:
    """Records of every collection of every dataset, zeros included."""
    counted = None
    for name in SCHEMAS:
        part = t[name].groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", F.lit(name).alias("collection"), "n")
        counted = part if counted is None else counted.unionAll(part)
    everything = t["datasets"].select("dataset", F.explode(F.array(*map(F.lit, SCHEMAS))).alias("collection"))
    return everything.join(counted, ["dataset", "collection"], "left").select("dataset", "collection", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def lookup(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of wanted (dataset, id) with the first record of that id by place; state is found or missing."""
    first = table.groupBy("dataset", "id").agg(F.min_by(F.struct(*[c for c in table.columns if c not in ("dataset", "id")]), "idx").alias("record"))
    return wanted.join(first, ["dataset", "id"], "left").withColumn("state", F.when(F.col("record").isNull(), "missing").otherwise("found"))


def atom_view(t: dict[str, DataFrame], wanted: DataFrame, kind: str | None = None) -> DataFrame:
    """lookup of atoms by kind; an atom of another kind is wrong-kind, which is not missing."""
    found = lookup(t["atoms"], wanted)
    return found if kind is None else found.withColumn("state", F.when((F.col("state") == "found") & (F.col("record.kind") != kind), "wrong-kind").otherwise(F.col("state")))


def payload_closure(t: dict[str, DataFrame]) -> DataFrame:
    """dataset and content_id of every payload that a dataset needs, companions included, each once."""
    p = F.col("payload")
    every = F.array(p["content_id"], p["layout"]["offsets"], p["layout"]["indices"], p["layout"]["indptr"], p["layout"]["scales"], F.col("time_axis.timestamps"))
    return t["atoms"].select("dataset", F.explode(F.array_compact(every)).alias("content_id")).distinct()
