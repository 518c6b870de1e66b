"""Adapters between foreign objects (files with paths) and datasets.

An adapter inspects, imports, plans an export, exports and validates. The forensic adapter keeps every file exactly, as a source capsule, and maps no meaning.
Single objects go through the classes; tables of files go through inspect_files, import_files and export_files.
"""

from __future__ import annotations

import hashlib
import json
import struct
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates
from ..functions.blake3 import derived
from ..functions.ident import Names, derived_hex
from ..model import build
from ..model.document import is_control
from ..model.exact import UNSIGNED

#: What an adapter can do, what every adapter must do, and what the status of a profile asks for beyond that.
CAPABILITIES = ("inspect", "import", "plan-export", "export", "validate", "stream", "hardware")
CORE = frozenset(CAPABILITIES[:5])
STATUS = {"forensic": frozenset(), "semantic": frozenset(), "stream": frozenset({"stream"}), "hardware": frozenset({"stream", "hardware"})}
LOSSLESS = ("exact", "quarantined")


class AdapterError(ValueError):
    def __init__(self, code: str, about: object = None) -> None:
        super().__init__(code if about is None else f"{code}: {about}")
        self.code, self.about = code, about


class File(NamedTuple):
    path: str
    media_type: str | None
    data: bytes


@dataclass(frozen=True)
class Profile:
    id: str
    standard: str
    edition: str
    media_types: tuple[str, ...]
    status: str
    required_validator: str
    capabilities: frozenset[str]


def is_media_type(text: str) -> bool:
    kind, slash, rest = text.partition("/")
    return bool(kind and slash and rest) and all("!" <= c <= "~" for c in text)


def parse_registry(data: bytes) -> dict[str, Profile]:
    """Profiles by id; ids differ, nothing is empty, and capabilities fit the status."""
    try:
        told = json.loads(data)
        rows = [Profile(p["id"], p["standard"], p["edition"], tuple(p["media_types"]), p["status"], p["required_validator"], frozenset(p["capabilities"])) for p in told["profiles"]]
    except (ValueError, KeyError, TypeError) as error:
        raise AdapterError("invalid-source", error) from None
    if told.get("schema_version") != 1 or not rows:
        raise AdapterError("invalid-source", "unsupported or empty registry")
    out: dict[str, Profile] = {}
    for p in rows:
        whole = all((p.id, p.standard, p.edition, p.media_types, p.required_validator, p.capabilities)) and all(map(is_media_type, p.media_types))
        if not whole or p.id in out or p.status not in STATUS or not p.capabilities <= set(CAPABILITIES):
            raise AdapterError("invalid-source", f"invalid or duplicate profile {p.id}")
        if not CORE | STATUS[p.status] <= p.capabilities:
            raise AdapterError("invalid-source", f"capabilities of {p.id} do not fit its status")
        out[p.id] = p
    return out


def registry_faults(profiles: DataFrame) -> DataFrame:
    """id and fault of the profiles (a row each, with the members of a registry) that a registry must not hold."""
    needed = F.create_map(*[x for s, more in STATUS.items() for x in (F.lit(s), F.array(*map(F.lit, sorted(CORE | more))))])
    texts = ["id", "standard", "edition", "required_validator"]
    empty = F.greatest(*[(F.length(c) == 0).cast("int") for c in texts]) + F.greatest(*[(F.size(c) == 0).cast("int") for c in ("media_types", "capabilities")]) > 0
    media = F.exists("media_types", lambda m: ~predicates.is_adapter_media(m))
    twice = profiles.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("id").alias("_id"))
    lacks = F.coalesce(F.size(F.array_except(F.element_at(needed, F.col("status")), "capabilities")) > 0, F.lit(True))
    fault = F.when(F.col("_id").isNotNull(), "duplicate").when(empty, "empty").when(media, "media-type").when(lacks, "capabilities")
    return profiles.join(twice, F.col("id") == F.col("_id"), "left").select("id", fault.alias("fault")).where("fault is not null").distinct()


def receipt_faults(receipts: DataFrame, profiles: DataFrame) -> DataFrame:
    """receipt, ord and fault of every way in which a validation receipt disagrees with itself or with the registry (profile, edition, status).

    receipts has receipt, profile, edition, expected_outcome, internal_valid, observed_outcome, expected_outcome_observed and authority (the last three null
    without independent evidence), pass and promoted. A receipt passes if the adapter and an independent conformance authority both saw the expected
    outcome; a profile is promoted if it passes and is registered as semantic.
    """
    known = profiles.select(F.col("profile").alias("_profile"), F.col("edition").alias("_edition"), F.col("status").alias("_status"))
    met = receipts.join(F.broadcast(known), F.col("profile") == F.col("_profile"), "left")
    internal = F.col("internal_valid") == (F.col("expected_outcome") == "accept")
    saw = F.col("observed_outcome") == F.col("expected_outcome")
    passes = internal & F.coalesce(saw & F.col("expected_outcome_observed") & (F.col("authority") == "conformance"), F.lit(False))
    promoted = passes & F.coalesce(F.col("_status") == "semantic", F.lit(False))
    tests = [
        (F.col("_profile").isNull(), "profile-not-registered"), (F.col("edition") != F.col("_edition"), "edition"), (~internal, "internal-outcome"), (F.col("expected_outcome_observed") != saw, "observed-outcome"),
        (F.col("pass") != passes, "pass"), (F.col("promoted") != promoted, "promotion"),
    ]
    faults = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("fault"))) for i, (test, name) in enumerate(tests)]))
    return met.select("receipt", F.explode(faults).alias("f")).select("receipt", "f.ord", "f.fault")


def is_path(path: str) -> bool:
    return bool(path) and "\\" not in path and not any(map(is_control, path)) and not {"", ".."} & set(path.split("/"))


def payload_id(data: bytes, names: Names = Names()) -> str:
    return derived(f"{names.concept}.adapter.payload.v1", [data])[0].hex()


def object_hash(profile: str, files: list[File], names: Names = Names()) -> bytes:
    """The hash of a foreign object: its profile, then path, media type and payload identity of each file in order."""
    counted = lambda b: struct.pack("<Q", len(b)) + b
    out = [counted(profile.encode())]
    for f, key in zip(files, derived(f"{names.concept}.adapter.payload.v1", [f.data for f in files]), strict=True):
        out += [counted(f.path.encode()), b"\0" if f.media_type is None else b"\1" + counted(f.media_type.encode()), key]
    return derived(f"{names.concept}.adapter.foreign-object.v1", [b"".join(out)])[0]


@dataclass(frozen=True)
class ExportPlan:
    source_dataset: str
    target_profile: str
    mappings: tuple[tuple[str, str, str, str | None], ...]  # source path, target, disposition, reason
    requires_user_acceptance: bool = False
    unsupported: bool = False
    plan_id: str = ""

    def accepts_without_loss(self) -> bool:
        return not self.requires_user_acceptance and not self.unsupported and all(m[2] in LOSSLESS for m in self.mappings)


def plan_identity(plan: ExportPlan, names: Names = Names()) -> str:
    """The identity of the plan's members in their order, with an empty identity."""
    keys = ("source_path", "target", "disposition", "reason")
    document = {
        "source_dataset": plan.source_dataset, "target_profile": plan.target_profile, "mappings": [dict(zip(keys, m, strict=True)) for m in plan.mappings],
        "requires_user_acceptance": plan.requires_user_acceptance, "unsupported": plan.unsupported, "plan_id": "",
    }
    return derived(f"{names.concept}.adapter.export-plan.v1", [json.dumps(document, separators=(",", ":"), ensure_ascii=False).encode()])[0].hex()


@dataclass(frozen=True)
class MappingReport:
    source_profile: str
    target_profile: str
    semantic_coverage: str  # exact-semantic, projected-semantic or forensic-only
    entries: tuple[tuple[str, str, str, str | None], ...]
    preserved_unknowns: int
    sample_values_changed: bool = False
    timing_changed: bool = False

    def first_class_semantic(self) -> bool:
        return self.semantic_coverage == "exact-semantic" and not self.sample_values_changed and not self.timing_changed and all(e[2] in LOSSLESS for e in self.entries)


class Adapter(ABC):
    profile: Profile

    @abstractmethod
    def inspect(self, profile: str, files: list[File]) -> dict: ...

    @abstractmethod
    def read(self, profile: str, files: list[File]) -> tuple[dict, MappingReport, dict[str, bytes]]: ...

    @abstractmethod
    def plan_export(self, dataset: dict) -> ExportPlan: ...

    @abstractmethod
    def export(self, dataset: dict, plan: ExportPlan, resolve: Callable[[str], bytes]) -> tuple[list[File], dict]: ...

    @abstractmethod
    def validate(self, profile: str, files: list[File]) -> dict: ...


class ForensicAdapter(Adapter):
    def __init__(self, profile: Profile, most_bytes: int, names: Names = Names()) -> None:
        self.profile, self.most_bytes, self.names = profile, most_bytes, names

    @property
    def namespace(self) -> str:
        return f"adapter.{self.profile.id}"

    def _check(self, profile: str, files: list[File]) -> int:
        if profile != self.profile.id:
            raise AdapterError("profile-mismatch", profile)
        if not files:
            raise AdapterError("empty-source")
        seen: set[str] = set()
        for f in files:
            if not is_path(f.path):
                raise AdapterError("invalid-path", f.path)
            if f.path in seen:
                raise AdapterError("duplicate-path", f.path)
            seen.add(f.path)
        total = sum(len(f.data) for f in files)
        if total > min(self.most_bytes, UNSIGNED):
            raise AdapterError("source-too-large", total)
        return total

    def inspect(self, profile: str, files: list[File]) -> dict:
        total = self._check(profile, files)
        return {"profile": profile, "entry_count": len(files), "logical_bytes": total, "risks": ["no semantic mapping; the source is kept exactly"], "required_resources": {"max-source-bytes": self.most_bytes}}

    def read(self, profile: str, files: list[File]) -> tuple[dict, MappingReport, dict[str, bytes]]:
        self._check(profile, files)
        out = build.empty(object_hash(profile, files, self.names)[:16].hex())
        keys = [payload_id(f.data, self.names) for f in files]
        out["source_capsules"] = [{"source": {"namespace": self.namespace, "value": f.path}, "content_id": k, "media_type": f.media_type} for f, k in zip(files, keys, strict=True)]
        entries = tuple((f.path, f"source-capsule:{k}", "quarantined", "exact bytes are kept") for f, k in zip(files, keys, strict=True))
        return build.valid(out), MappingReport(profile, f"{self.names.concept}.semantic.v1", "forensic-only", entries, len(files)), {k: f.data for f, k in zip(files, keys, strict=True)}

    def plan_export(self, dataset: dict) -> ExportPlan:
        paths = [c["source"]["value"] for c in dataset["source_capsules"] if c["source"]["namespace"] == self.namespace]
        plan = ExportPlan(dataset["dataset_id"], self.profile.id, tuple((p, p, "exact", None) for p in paths), unsupported=not paths)
        return ExportPlan(**{**plan.__dict__, "plan_id": plan_identity(plan, self.names)})

    def export(self, dataset: dict, plan: ExportPlan, resolve: Callable[[str], bytes]) -> tuple[list[File], dict]:
        if plan != self.plan_export(dataset):
            raise AdapterError("export-plan-mismatch")
        if not plan.accepts_without_loss():
            raise AdapterError("unsupported-meaning" if plan.unsupported else "export-requires-acceptance")
        files, ids = [], []
        for c in dataset["source_capsules"]:
            if c["source"]["namespace"] == self.namespace:
                data = resolve(c["content_id"])
                if payload_id(data, self.names) != c["content_id"]:
                    raise AdapterError("missing-payload", c["content_id"])
                files.append(File(c["source"]["value"], c["media_type"], data))
                ids.append(c["content_id"])
        return files, {"plan_id": plan.plan_id, "exact_source_restoration": True, "semantic_equivalence": False, "output_content_ids": ids}

    def validate(self, profile: str, files: list[File]) -> dict:
        """What the adapter itself finds; the verdict of an independent validator is never its own to give."""
        try:
            self._check(profile, files)
            faults: list[str] = []
        except AdapterError as error:
            faults = [str(error)]
        return {"profile": self.profile.id, "internal_valid": not faults, "independent_validator": self.profile.required_validator, "independent_valid": None, "diagnostics": faults}


@dataclass
class AdapterRegistry:
    """Adapters by profile; the first one of a profile stays, and a profile without one names the package that would have it."""

    adapters: dict[str, Adapter] = field(default_factory=dict)
    providers: dict[str, str] = field(default_factory=dict)

    def register(self, adapter: Adapter) -> None:
        if adapter.profile.id in self.adapters:
            raise AdapterError("invalid-source", f"duplicate adapter {adapter.profile.id}")
        self.adapters[adapter.profile.id] = adapter

    def declare_provider(self, profile: str, package: str) -> None:
        if profile in self.providers:
            raise AdapterError("invalid-source", f"duplicate provider {profile}")
        self.providers[profile] = package

    def get(self, profile: str) -> Adapter:
        if profile not in self.adapters:
            raise AdapterError("adapter-unavailable", self.providers.get(profile, "unregistered-adapter"))
        return self.adapters[profile]


def inspect_files(files: DataFrame, most_bytes: int) -> DataFrame:
    """One row an object (files has object, path and data): entries, bytes and the first fault of its paths and size, null if there is none."""
    bytes_ = F.octet_length("data").cast("decimal(38,0)")
    seen = files.groupBy("object", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_).alias("bytes"))
    fault = F.when(~predicates.is_adapter_path("path"), "invalid-path").when(F.col("n") > 1, "duplicate-path")
    per = seen.groupBy("object").agg(F.sum("n").alias("entry_count"), F.sum("bytes").alias("logical_bytes"), F.min(F.when(fault.isNotNull(), F.struct("path", fault.alias("code")))).alias("f"))
    large = F.when(F.col("logical_bytes") > F.lit(str(min(most_bytes, UNSIGNED))).cast("decimal(38,0)"), "source-too-large")
    return per.select("object", "entry_count", F.col("logical_bytes").cast("decimal(38,0)").alias("logical_bytes"), F.coalesce("f.code", large).alias("fault"))


def import_files(files: DataFrame, profile: str, names: Names = Names()) -> DataFrame:
    """Source capsules of files (object, path, media_type, data): namespace, value, content_id and media_type, with the bytes."""
    identity = derived_hex(F.col("data"), f"{names.concept}.adapter.payload.v1")
    return files.select("object", F.lit(f"adapter.{profile}").alias("namespace"), F.col("path").alias("value"), identity.alias("content_id"), "media_type", "data")


def export_files(capsules: DataFrame, payloads: DataFrame, profile: str) -> DataFrame:
    """Files of the capsules of one profile with their bytes; state is exact or missing-payload."""
    mine = capsules.where(F.col("namespace") == f"adapter.{profile}")
    met = mine.join(payloads.select(F.col("content_id").alias("_c"), F.col("data").alias("_data")).dropDuplicates(["_c"]), F.col("content_id") == F.col("_c"), "left")
    state = F.when(F.col("_c").isNull(), "missing-payload").otherwise("exact")
    return met.select("object", F.col("value").alias("path"), "media_type", "content_id", F.col("_data").alias("data"), state.alias("state"))


def read_folder(spark: SparkSession, path: str, object_name: str = "folder") -> DataFrame:
    """Files below a folder as a foreign object; paths are relative to it. Spark's file sources leave out files of no bytes; give those from a list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.lit(object_name).alias("object"), F.substring_index("path", path.rstrip("/") + "/", -1).alias("path"), F.lit(None).cast("string").alias("media_type"), F.col("content").alias("data"))


def tree_digest(files: DataFrame, names: Names = Names()) -> DataFrame:
    """object and the SHA-256 of a domain and its files in path order, each as length and bytes of path and content; lengths are big-endian.

    Files are streamed in order, so an object need not fit in memory; one object is one task's work, as its digest is one chain.
    """
    domain = f"{names.concept}.adapter.fixture-tree.v1".encode() + b"\0"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple[str, object] | None = None
        for batch in batches:
            for name, rows in groupby(zip(batch["object"], batch["path"], batch["data"], strict=True), key=lambda r: r[0]):
                if state is None or state[0] != name:
                    if state:
                        yield pd.DataFrame({"object": [state[0]], "digest": [state[1].hexdigest()]})
                    state = (name, hashlib.sha256(domain))
                for _, path, data in rows:
                    for part in (path.encode(), bytes(data)):
                        state[1].update(struct.pack(">Q", len(part)) + part)
        if state:
            yield pd.DataFrame({"object": [state[0]], "digest": [state[1].hexdigest()]})

    return files.select("object", "path", "data").repartition("object").sortWithinPartitions("object", "path").mapInPandas(run, "object string, digest string")
