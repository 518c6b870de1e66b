"""The single-object interface end to end."""

import hashlib
import json

import numpy as np
import pytest

from brindle import api
from brindle.functions.blake3 import blake3
from brindle.functions.ident import Names
from brindle.model import build, document
from brindle.sources import container as C
from brindle.training import records as R

FMT = C.Format(b"TESTBOX2", b"TESTIDX\0", b"TESTGEN\0")
IDS = {name: f"{i:032x}" for i, name in enumerate(("dataset", "recording", "stream", "atom", "clock"), 1)}
k = lambda n: f"{n:02x}" * 32
SPEC = {**{name: k(i + 1) for i, name in enumerate(R.SPEC_KEYS)}, "authorized_purpose": "research", "seed": 1, "allowed_adaptive_knobs": ["lr"]}
RECORDS = [{"activation_barrier": 0, "decision": k(9), "durable_before_activation": True, "knob": "lr", "rank": 0, "sequence": 0}]


def test_datasets():
    array = np.arange(6, dtype=np.float32).reshape(2, 3)
    d = api.Dataset.from_tensor(array, IDS, "a:b", (256, 1))
    assert (d.numpy_view(IDS["atom"]) == array).all() and d.family_counts()["atoms"] == 1
    again = api.Dataset.from_canonical_json(d.canonical_json().encode(), d.payloads)
    assert again.content_id() == d.content_id() != d.interchange_id() and (again.numpy_view(IDS["atom"]) == array).all()
    with pytest.raises(KeyError):
        d.atom("0" * 32)
    with pytest.raises(ValueError, match="tensor"):
        d.atom(IDS["atom"], "table")
    with pytest.raises(document.DocumentError, match="canonical"):
        api.Dataset.from_canonical_json(json.dumps(json.loads(d.canonical_json()) | {"x": 1}).encode())
    key, = d.payloads
    for wrong, message in ((b"1", "length"), (bytes(24), "content")):
        with pytest.raises(api.PayloadMismatch, match=message):
            api.Dataset(d.document, api.MemoryPayloads({key: wrong})).numpy_view(IDS["atom"])
    sample = api.Dataset(build.valid(build.sample()))
    withheld = next(a["id"] for a in sample.document["atoms"] if a["presence"] == "withheld")
    with pytest.raises(ValueError, match="withheld"):
        sample.payload_bytes(withheld)


def store(roots, n=3, profile="compact", log=k(3)):
    names = Names()
    rows, labels = [], []
    for i in range(n):
        data = np.array([i, -i], ">i2").tobytes()
        rows.append(({"byte_order": "big", "element": "i16", "group": k(20), "label": k(21), "logical_bytes": 4, "logical_id": f"{i:064x}", "payload": blake3(names.payload("i16") + data).hex(), "shape": [2], "split": k(22)}, data))
    mask = b"\1\0"
    described = {"byte_order": "not-applicable", "element": "bool", "logical_bytes": 2, "payload": blake3(names.payload("bool") + mask).hex(), "shape": [2]}
    labels = [({"concept": "seg.mask", "logical_id": f"{0:064x}", "payload": described, "presence": "present"}, mask), ({"concept": "seg.other", "logical_id": f"{0:064x}", "payload": None, "presence": "redacted"}, None)]
    made = api.seal_training_snapshot(FMT, dataset_roots=roots, spec_id=R.spec_id(SPEC), profile=profile, rows=rows, label_payloads=labels, decision_log_id=log)
    return made


def test_stores(tmp_path):
    made = store([k(1)])
    s = api.TrainingStore.open_bytes(FMT, made["artifact"])
    (tmp_path / "s").write_bytes(made["artifact"])
    assert s.snapshot_id == made["snapshot_id"] == api.TrainingStore.open_path(FMT, str(tmp_path / "s")).snapshot_id and s.artifact_sha256 == hashlib.sha256(made["artifact"]).hexdigest()
    assert s.row_ids() == [f"{i:064x}" for i in range(3)] and s.row_numpy(f"{2:064x}").tolist() == [2, -2]
    info = s.row_info(f"{1:064x}")
    assert made["artifact"][info["offset"] : info["offset"] + 4] == s.lease(f"{1:064x}")
    assert s.label_numpy(f"{0:064x}", "seg.mask").tolist() == [True, False]
    with pytest.raises(ValueError, match="redacted"):
        s.label_numpy(f"{0:064x}", "seg.other")
    for missing in (lambda: s.row("x"), lambda: s.label(f"{1:064x}", "seg.mask")):
        with pytest.raises(KeyError):
            missing()
    assert s.execute_training_plan()["row_count"] == 3
    with pytest.raises(ValueError, match="backing"):
        api.TrainingStore.open_path(FMT, str(tmp_path / "s")).execute_training_plan()
    with pytest.raises(OSError):
        api.TrainingStore.open_path(FMT, str(tmp_path / "none"))


def test_sealing_and_verifying():
    plan = api.compile_training_execution_plan("balanced")
    assert json.loads(plan["canonical_json"])["profile"] == "balanced" and len(plan["plan_id"]) == 64
    log = api.seal_training_decision_log(spec=SPEC, records=RECORDS)
    stores = [api.TrainingStore.open_bytes(FMT, store([k(root)], n, log=log["decision_log_id"])["artifact"]) for root, n in ((1, 2), (2, 2), (1, 3))]
    replay = api.verify_training_decision_replay(store=stores[0], spec=SPEC, decision_log=log["decision_log"], records=RECORDS)
    assert replay["record_count"] == 1 and replay["decision_log_id"] == log["decision_log_id"]
    same = api.verify_training_source_equivalence(stores[0], stores[1])
    assert same["row_count"] == 2 and same["first_dataset_roots_id"] != same["second_dataset_roots_id"]
    with pytest.raises(ValueError, match="source-snapshot-mismatch"):
        api.verify_training_source_equivalence(stores[0], stores[2])
    event = lambda n, s, prior: {"correction": prior, "generation": n, "logical_id": k(5), "sequence": n, "snapshot_id": s.snapshot_id, "watermark": n}
    events = [event(0, stores[0], None), event(1, stores[2], {"prior_generation": 0, "prior_snapshot_id": stores[0].snapshot_id})]
    made = api.seal_training_continual_promotion(subscription_id=k(7), events=events, spec=SPEC, snapshots=[stores[0], stores[2]], decision_logs=[log["decision_log"]] * 2, decision_replays=[RECORDS] * 2)
    assert made["entry_count"] == 2 and json.loads(made["promotion"])["closed_subscription_id"] == made["closed_subscription_id"]
    with pytest.raises(ValueError, match="members"):
        api.seal_training_decision_log(spec=SPEC, records=[RECORDS[0] | {"more": 1}])
    with pytest.raises(ValueError, match="not-canonical"):
        api.verify_training_decision_replay(store=stores[0], spec=SPEC, decision_log=log["decision_log"] + " ", records=RECORDS)


def test_manifests():
    files = {"a": b"1", "b": b"2"}
    row = lambda n, d: {"name": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()}
    told = {"vectors": [row("a", b"1"), row("b", b"3"), row("c", b""), row("a", b"1")]}
    assert api.manifest_faults(json.dumps(told).encode(), files.__getitem__) == ["b: changed", "c: missing", "a: repeated"]
