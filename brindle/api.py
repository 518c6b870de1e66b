"""The engine's single-object interface: datasets and training stores as Python objects, and the sealing and verifying functions.

Every function takes and gives plain values; faults are ValueError, KeyError or OSError with the fault's text. Tables of many objects go through
model.tables, training.tables and sources.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np

from .functions.blake3 import blake3
from .functions.ident import Names, canonical_json
from .model import build, document
from .plans.execution import compile_plan
from .sources import bundles
from .sources import container as C
from .training import records as R


class PayloadSource(Protocol):
    """Where payload bytes come from."""

    def lease(self, content_id: str) -> bytes: ...


class PayloadMismatch(ValueError):
    pass


def verify_payload(described: dict, data: bytes, names: Names = Names()) -> None:
    """Length first, then identity."""
    if len(data) != described["logical_bytes"]:
        raise PayloadMismatch(f"length {len(data)} instead of {described['logical_bytes']}")
    if blake3(names.payload(described["element"]) + data).hex() != described["content_id"]:
        raise PayloadMismatch(f"content is not {described['content_id']}")


class MemoryPayloads(dict):
    """Payload bytes by content id."""

    def lease(self, content_id: str) -> bytes:
        return self[content_id]


class Dataset:
    """A dataset document with, where it has them, its payloads."""

    def __init__(self, found: dict, payloads: PayloadSource | None = None, names: Names = Names()) -> None:
        self.document, self.payloads, self.names = found, payloads, names

    @classmethod
    def from_canonical_json(cls, data: bytes, payloads: PayloadSource | None = None, names: Names = Names()) -> Dataset:
        """Reads a document that is in canonical form. Its rules are checked by model.rules, over any number of documents."""
        found = document.read(data)
        if not document.is_canonical(data, found):
            raise document.DocumentError("$", "document is not in its canonical form")
        return cls(found, payloads, names)

    @classmethod
    def from_tensor(cls, array: np.ndarray, ids: dict[str, str], modality: str, rate: tuple[int, int] = (1, 1), names: Names = Names()) -> Dataset:
        found, data = build.from_tensor(array, ids, modality, rate, names)
        return cls(build.valid(found), MemoryPayloads({found["atoms"][0]["payload"]["content_id"]: data}), names)

    def canonical_json(self) -> str:
        return document.debug_json(self.document)

    def content_id(self) -> str:
        return document.identities([self.document], "logical", self.names)[0]

    def interchange_id(self) -> str:
        return document.identities([self.document], "interchange", self.names)[0]

    def family_counts(self) -> dict[str, int]:
        return {name: len(self.document[name]) for name in document.COLLECTIONS}

    def find(self, collection: str, identity: str) -> dict:
        """The first record of an id; KeyError if there is none."""
        found = next((r for r in self.document[collection] if r["id"] == identity), None)
        if found is None:
            raise KeyError(f"no {collection} record {identity}")
        return found

    def atom(self, identity: str, kind: str | None = None) -> dict:
        """An atom by id; another kind than asked for is a ValueError, which a missing atom is not."""
        found = self.find("atoms", identity)
        if kind is not None and found["kind"] != kind:
            raise ValueError(f"atom {identity} is a {found['kind']}, not a {kind}")
        return found

    def payload_bytes(self, identity: str) -> bytes:
        found = self.atom(identity)
        if found["payload"] is None:
            raise ValueError(f"atom {identity} is {found['presence']}")
        if self.payloads is None:
            raise KeyError(found["payload"]["content_id"])
        data = self.payloads.lease(found["payload"]["content_id"])
        verify_payload(found["payload"], data, self.names)
        return data

    def numpy_view(self, identity: str) -> np.ndarray:
        """The values of a row-major tensor."""
        p = self.atom(identity, "tensor")["payload"]
        data = self.payload_bytes(identity)
        if p["layout"] != "dense-row-major":
            raise ValueError(f"layout {p['layout']} has no view")
        return build.decode(data, p["element"], p["byte_order"], p["shape"])


class TrainingStore:
    """An opened training store: rows and labels by key, decoded values, and the execution of its plan."""

    def __init__(self, fmt: C.Format, artifact: bytes, backing: str, bounds: C.Bounds = C.Bounds()) -> None:
        self.fmt, self.artifact, self.backing = fmt, artifact, backing
        found = bundles.open_store(fmt, artifact, bounds)
        self.snapshot, self.snapshot_id, self._payloads, self._places = (found[k] for k in ("snapshot", "snapshot_id", "payloads", "places"))
        self._rows = {r["logical_id"]: r for r in self.snapshot["rows"]}
        self._labels = {(x["logical_id"], x["concept"]): x for x in self.snapshot.get("label_payloads", [])}

    @classmethod
    def open_bytes(cls, fmt: C.Format, data: bytes) -> TrainingStore:
        return cls(fmt, bytes(data), "bytes")

    @classmethod
    def open_path(cls, fmt: C.Format, path: str) -> TrainingStore:
        """Reads a private copy, so that later changes of the file have no effect."""
        with open(path, "rb") as file:
            return cls(fmt, file.read(), "path")

    @property
    def artifact_sha256(self) -> str:
        return hashlib.sha256(self.artifact).hexdigest()

    def row_ids(self) -> list[str]:
        return list(self._rows)

    def row(self, logical_id: str) -> dict:
        return self._rows[logical_id]

    def row_info(self, logical_id: str) -> dict:
        """A row's description and where its payload lies in the artifact."""
        r = self._rows[logical_id]
        offset, _ = self._places[r["payload"]]
        return {k: r[k] for k in ("logical_id", "group", "split", "label", "payload", "element", "byte_order", "shape", "logical_bytes")} | {"offset": offset}

    def lease(self, logical_id: str) -> bytes:
        return self._payloads[self._rows[logical_id]["payload"]]

    def row_numpy(self, logical_id: str) -> np.ndarray:
        r = self._rows[logical_id]
        return build.decode(self.lease(logical_id), r["element"], r["byte_order"], r["shape"])

    def label(self, logical_id: str, concept: str) -> dict:
        return self._labels[logical_id, concept]

    def label_numpy(self, logical_id: str, concept: str) -> np.ndarray:
        """The values of a label; one that is not present is a ValueError that names its state."""
        x = self._labels[logical_id, concept]
        if x["payload"] is None:
            raise ValueError(f"label {concept} of {logical_id} is {x['presence']}")
        p = x["payload"]
        return build.decode(self._payloads[p["payload"]], p["element"], p["byte_order"], p["shape"])

    def execute_training_plan(self) -> dict:
        return R.execute(self.snapshot, self._payloads, self.artifact, self.backing, self.fmt.names)


def _checked(rows: Iterable[object], members: Iterable[str], what: str) -> list[dict]:
    return [R.exact_members(r, members, what) for r in rows]


ROW = ("byte_order", "group", "label", "logical_bytes", "logical_id", "payload", "element", "shape", "split")
LABEL = ("concept", "logical_id", "payload", "presence")
EVENT = ("correction", "generation", "logical_id", "sequence", "snapshot_id", "watermark")


def compile_training_execution_plan(profile: str, names: Names = Names(), **overrides: object) -> dict:
    plan = compile_plan(profile, **overrides)
    return {"canonical_json": canonical_json(R.plan_document(plan, names)), "plan_id": R.plan_id(plan, names)}


def seal_training_decision_log(*, spec: dict, records: list[dict], names: Names = Names()) -> dict:
    log = R.seal_decision_log(spec, _checked(records, R.DECISION, "decision record"), names)
    return {"spec_id": log["spec_id"], "decision_log_id": R.decision_log_id(log, names), "decision_log": canonical_json(log)}


def _log(text: str, names: Names) -> dict:
    return R.reopened(text.encode(), lambda log: R.validate_decision_log(log, names))


def verify_training_decision_replay(*, store: TrainingStore, spec: dict, decision_log: str, records: list[dict], names: Names = Names()) -> dict:
    """The receipt of a replay, bound to the store whose snapshot names the log and the specification."""
    log = _log(decision_log, names)
    R.require(store.snapshot["spec_id"] == R.spec_id(spec, names), "decision-spec-mismatch")
    R.require(store.snapshot["decision_log_id"] == R.decision_log_id(log, names), "decision-log-mismatch")
    receipt = R.replay_receipt(spec, log, records, names)
    return {k: receipt[k] for k in ("decision_log_id", "spec_id", "record_count")} | {"receipt_id": R.receipt_id(receipt, names), "receipt": canonical_json(receipt)}


def verify_training_source_equivalence(first: TrainingStore, second: TrainingStore) -> dict:
    names = first.fmt.names
    receipt = R.equivalence_receipt(first.snapshot, second.snapshot, names, ({r: first.lease(r) for r in first.row_ids()}, {r: second.lease(r) for r in second.row_ids()}))
    return {k: v for k, v in receipt.items() if k not in ("schema", "verified")} | {"receipt_id": R.receipt_id(receipt, names), "receipt": canonical_json(receipt)}


def seal_training_snapshot(fmt: C.Format, *, dataset_roots: list[str], spec_id: str, profile: str, rows: list[tuple[dict, bytes]], label_payloads: list[tuple[dict, bytes | None]] = (), decision_log_id: str) -> dict:
    """A snapshot with the bytes of its rows and labels as one artifact."""
    described = _checked([r for r, _ in rows], ROW, "row")
    labels = _checked([x for x, _ in label_payloads], LABEL, "label")
    snapshot = R.seal_snapshot(dataset_roots, spec_id, profile, described, decision_log_id, labels, fmt.names)
    frames = {r["payload"]: (r["element"], data) for r, data in rows} | {x["payload"]["payload"]: (x["payload"]["element"], data) for x, data in label_payloads if x["payload"] is not None}
    return {"snapshot_id": R.snapshot_id(snapshot, fmt.names), "artifact": bundles.encode_store(fmt, snapshot, list(frames.values()))}


def seal_training_continual_promotion(*, subscription_id: str, events: list[dict], spec: dict, snapshots: list[TrainingStore], decision_logs: list[str], decision_replays: list[list[dict]], names: Names = Names()) -> dict:
    """Closes a subscription and promotes its events, each with its store, decision log and replay."""
    closed = R.close_subscription(subscription_id, _checked(events, EVENT, "event"), names)
    R.require(len(decision_logs) == len(decision_replays), "incomplete-continual-promotion", len(events))
    logs = [_log(text, names) for text in decision_logs]
    receipts = [R.replay_receipt(spec, log, replay, names) for log, replay in zip(logs, decision_replays, strict=True)]
    promotion = R.seal_promotion(closed, spec, [s.snapshot for s in snapshots], logs, receipts, names)
    return {"closed_subscription": canonical_json(closed), "closed_subscription_id": R.subscription_id(closed, names), "entry_count": len(promotion["entries"]), "promotion": canonical_json(promotion), "promotion_id": R.promotion_id(promotion, names)}


def manifest_faults(manifest: bytes, read: Callable[[str], bytes]) -> list[str]:
    """Names of a manifest's files (name, bytes, sha256) that are repeated, missing, or not what it says."""
    told, faults, seen = json.loads(manifest), [], set()
    for v in told["vectors"]:
        if v["name"] in seen:
            faults.append(f"{v['name']}: repeated")
            continue
        seen.add(v["name"])
        try:
            data = read(v["name"])
        except (OSError, KeyError):
            faults.append(f"{v['name']}: missing")
            continue
        if (len(data), hashlib.sha256(data).hexdigest()) != (v["bytes"], v["sha256"]):
            faults.append(f"{v['name']}: changed")
    return faults
