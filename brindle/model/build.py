"""Builders of dataset documents."""

from __future__ import annotations

import numpy as np

from ..functions import blake3
from ..functions.ident import Names
from .document import COLLECTIONS, read
from .exact import reduced


def exact(n: int, d: int = 1) -> dict:
    n, d = reduced(n, d)
    return {"$rational": [str(n), str(d)]}


def empty(dataset_id: str) -> dict:
    return {"semantic_version": "1", "dataset_id": dataset_id, **{name: [] for name in COLLECTIONS}}


def payload(content_id: str, element: str, shape: list[int], logical_bytes: int, byte_order: str = "little", layout: str | dict = "dense-row-major", encoding: str | None = None, media_type: str | None = None) -> dict:
    return {"content_id": content_id, "element": element, "shape": shape, "logical_bytes": logical_bytes, "byte_order": byte_order, "layout": layout, "encoding": encoding, "media_type": media_type}


#: NumPy types by element; there is none for 24-bit integers, and texts have no width.
DTYPES = {"i8": "i1", "i16": "i2", "i32": "i4", "i64": "i8", "u8": "u1", "u16": "u2", "u32": "u4", "u64": "u8", "f16": "f2", "f32": "f4", "f64": "f8", "bool": "?", "bytes": "u1"}


def from_tensor(array: np.ndarray, ids: dict[str, str], modality: str, rate: tuple[int, int], names: Names = Names()) -> tuple[dict, bytes]:
    """A dataset of one recording, stream, clock and tensor, and the tensor's bytes. ids has dataset, recording, stream, atom and clock."""
    element = next((e for e, t in DTYPES.items() if np.dtype(t) == array.dtype.newbyteorder("=")), None)
    if element is None or not array.size:
        raise ValueError("the array's type is not an element type, or it is empty")
    data = np.ascontiguousarray(array).astype(array.dtype.newbyteorder("<")).tobytes()
    ns = names.concept
    order = "little" if array.dtype.itemsize > 1 else "not-applicable"
    content = blake3.blake3(names.payload(element) + data).hex()
    out = empty(ids["dataset"])
    out["recordings"] = [{"id": ids["recording"], "streams": [ids["stream"]], "source_keys": []}]
    out["streams"] = [{"id": ids["stream"], "recording_id": ids["recording"], "modality": modality, "atoms": [ids["atom"]], "clock_id": ids["clock"], "channel_basis_id": None, "policy_id": None}]
    out["clocks"] = [{"id": ids["clock"], "kind": f"{ns}:clock/device", "parent_id": None, "offset": exact(0), "rate": exact(*rate), "uncertainty": exact(0)}]
    axes = [{"semantic": f"{ns}:axis/sample", "extent": n} for n in array.shape]
    described = payload(content, element, list(array.shape), len(data), order, encoding=f"{ns}:encoding/raw")
    out["atoms"] = [{"id": ids["atom"], "kind": "tensor", "presence": "present", "payload": described, "axes": axes}]
    return out, data


def decode(data: bytes, element: str, byte_order: str, shape: list[int], layout: str = "dense-row-major") -> np.ndarray:
    """The values of a dense payload; 24-bit integers become 32-bit ones, bytes stay unsigned. Texts have no dense form."""
    if element == "i24":
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3)
        raw = raw[:, ::-1] if byte_order == "big" else raw
        wide = raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8 | raw[:, 2].astype(np.int32) << 16
        flat = (wide ^ 0x800000) - 0x800000
    elif element in DTYPES:
        flat = np.frombuffer(data, np.dtype(DTYPES[element]).newbyteorder(">" if byte_order == "big" else "<"))
    else:
        raise ValueError(f"{element} has no dense form")
    return flat.reshape(shape, order="F" if layout == "dense-column-major" else "C")


def sample(names: Names = Names()) -> dict:
    """A valid dataset with a record in every collection, an atom of every kind, every composite layout and every presence state."""
    ns = names.concept
    i, c = (lambda n: f"{n:032x}"), (lambda n: f"{n:064x}")
    out = empty(i(1))
    for at, (name, kind) in enumerate((("subjects", "subject/human"), ("patients", "patient/clinical"), ("sessions", "session/recording"), ("acquisitions", "acquisition/eeg"), ("devices", "device/amplifier"), ("sensors", "sensor/electrode"), ("channels", "channel/fp1"), ("concept_dictionaries", "dictionary/core"))):
        out[name] = [{"id": i(0x20 + at), "kind": f"{ns}:{kind}", "source_keys": [{"namespace": "file.field", "value": f"{name}-1"}] if at < 2 else []}]
    ends = (("patient-subject", "patient_id", 0x21, "subject_id", 0x20), ("session-subject", "session_id", 0x22, "subject_id", 0x20), ("session-patient", "session_id", 0x22, "patient_id", 0x21),
            ("acquisition-session", "acquisition_id", 0x23, "session_id", 0x22), ("acquisition-device", "acquisition_id", 0x23, "device_id", 0x24), ("device-sensor", "device_id", 0x24, "sensor_id", 0x25),
            ("sensor-channel", "sensor_id", 0x25, "channel_id", 0x26), ("acquisition-recording", "acquisition_id", 0x23, "recording_id", 2))
    out["source_relationships"] = [{"kind": kind, a: i(x), b: i(y)} for kind, a, x, b, y in ends] + [{"kind": "channel-basis-member", "channel_id": i(0x26), "basis_id": i(8), "position": 1}]
    out["recordings"] = [{"id": i(2), "streams": [i(3)], "source_keys": []}]
    layouts = [
        ("ragged", "bytes", [2, 1], 5, {"ragged": {"rows": 2, "offsets": c(0x101)}}, "not-applicable"), ("sparse-coo", "i16", [2, 2], 4, {"sparse-coo": {"nonzero": 2, "indices": c(0x102)}}, "little"),
        ("bfp", "i16", [2, 4], 12, {"bfp": {"block_len": 3, "mantissa_bits": 12, "scales": c(0x105)}}, "little"), ("sparse-csr", "i16", [2, 2], 4, {"sparse-csr": {"nonzero": 2, "indptr": c(0x103), "indices": c(0x104)}}, "little"),
    ]
    segment = lambda start, rate, n: {"start": exact(start), "rate": exact(rate), "samples": n}
    columns = lambda n: [{"semantic": f"{ns}:column/{k}", "element": "i16", "nullable": k > 0} for k in range(n)]
    axes = lambda shape: [{"semantic": f"{ns}:axis/a{k}", "extent": n} for k, n in enumerate(shape)]
    atoms = [
        {"kind": "signal-block", "payload": payload(c(0x201), "i16", [2, 4], 16), "time_axis": {"piecewise": [segment(0, 256, 1), segment(1, 512, 3)]}, "calibration": {"scale": exact(1, 10), "offset": exact(-2), "unit": "ucum:uV"}},
        {"kind": "signal-block", "payload": payload(c(0x202), "f32", [3], 12), "time_axis": {"explicit": {"timestamps": c(0x106), "count": 3}}, "calibration": None},
        {"kind": "temporal-table", "payload": payload(c(0x203), *layouts[0][1:4], layouts[0][5], layouts[0][4]), "clock_id": i(4), "record_kind": f"{ns}:record/annotation", "columns": columns(1)},
        {"kind": "table", "payload": payload(c(0x204), *layouts[1][1:4], layouts[1][5], layouts[1][4]), "columns": columns(2)},
        {"kind": "tensor", "payload": payload(c(0x205), *layouts[2][1:4], layouts[2][5], layouts[2][4]), "axes": axes([2, 4])},
        {"kind": "tensor", "payload": payload(c(0x206), *layouts[3][1:4], layouts[3][5], layouts[3][4]), "axes": axes([2, 2])},
        {"kind": "encoded-block", "payload": payload(c(0x207), "bytes", [4], 4, "not-applicable"), "decoded_semantics": {"atom_kind": f"{ns}:atom/tensor", "element": "i16", "shape": [2, 2]}},
        {"kind": "blob-ref", "payload": payload(c(0x208), "bytes", [3], 3, "not-applicable"), "media_type": "application/octet-stream", "integrity": {"algorithm": f"{ns}:integrity/blake3", "digest": c(0x208)}},
    ]
    for content, element, shape in ((0x101, "i32", [3]), (0x102, "u32", [2, 2]), (0x103, "u32", [3]), (0x104, "u32", [2]), (0x105, "f32", [3]), (0x106, "i64", [3])):
        size = int(np.prod(shape)) * int(element[1:]) // 8
        atoms.append({"kind": "tensor", "payload": payload(c(content), element, shape, size), "axes": axes(shape)})
    out["atoms"] = [{"id": i(0x40 + n), "presence": "present", **a} for n, a in enumerate(atoms)]
    for n, state in enumerate(("absent-at-source", "unknown-at-source", "withheld", "redacted", "not-applicable")):
        out["atoms"].append({"id": i(0x60 + n), "presence": state, "payload": None, "kind": "table", "columns": columns(1)})
    out["streams"] = [{"id": i(3), "recording_id": i(2), "modality": f"{ns}:modality/eeg", "atoms": [a["id"] for a in out["atoms"]], "clock_id": i(4), "channel_basis_id": i(8), "policy_id": i(9)}]
    clock = lambda n, parent, offset: {"id": i(n), "kind": f"{ns}:clock/device", "parent_id": parent, "offset": offset, "rate": exact(1), "uncertainty": exact(1, 1000000)}
    out["clocks"] = [clock(4, None, exact(0)), clock(5, i(4), exact(1, 1000))]
    identity = [{"$integer": str(int(k % 5 == 0))} for k in range(16)]
    out["coordinate_frames"] = [{"id": i(6), "kind": f"{ns}:frame/head", "parent_id": None, "transform": identity, "uncertainty": exact(1, 1000)}, {"id": i(7), "kind": f"{ns}:frame/sensor", "parent_id": i(6), "transform": None, "uncertainty": exact(0)}]
    out["channel_bases"] = [{"id": i(8), "reference": "differential", "channels": [{"concept": "eeg:channel/fp1", "coordinate_frame_id": i(6), "source_keys": [{"namespace": "file.signal", "value": "Fp1"}]}, {"concept": "eeg:channel/fp2", "coordinate_frame_id": None, "source_keys": []}]}]
    out["clock_relations"] = [{"id": i(0x30), "from_clock_id": i(4), "to_clock_id": i(5), "offset": exact(1, 1000), "rate": exact(1), "uncertainty": exact(1, 1000000), "method": f"{ns}:clock-relation/measured", "validity_start": exact(0), "validity_end": exact(10), "provenance": c(0x301)}]
    out["frame_transforms"] = [{"id": i(0x31), "from_frame_id": i(7), "to_frame_id": i(6), "transform": [*identity[:15], exact(3, 2)], "uncertainty": exact(1, 1000), "method": f"{ns}:frame-transform/measured"}]
    out["events"] = [{"id": i(0x32), "kind": f"{ns}:event/stimulus", "clock_id": i(4), "start": exact(1, 2), "end": exact(3, 4), "uncertainty": exact(0)}]
    out["derived_artifacts"] = [{"id": i(0x33), "content_id": c(0x302), "derivation_id": i(0x34)}]
    out["derivations"] = [{"id": i(0x34), "operation": f"{ns}:operation/derive", "inputs": [{"kind": "atom", "id": i(0x40)}], "outputs": [{"kind": "derived-artifact", "id": i(0x33)}]}]
    out["policies"] = [{"id": i(9), "parent_id": None, "restrictions": [f"{ns}:policy/research-only"]}, {"id": i(10), "parent_id": i(9), "restrictions": [f"{ns}:policy/no-export", f"{ns}:policy/research-only"]}]
    out["proofs"] = [{"id": i(0x35), "kind": f"{ns}:proof/policy-attestation", "subject": {"kind": "policy", "id": i(9)}, "payload": c(0x303)}]
    out["fidelity"] = [{"subject": {"kind": "atom", "id": i(0x40)}, "kind": "exact", "metric": None, "bound": None}, {"subject": {"kind": "dataset", "id": i(1)}, "kind": "bounded", "metric": f"{ns}:metric/error", "bound": {"$integer": "3"}}]
    out["source_capsules"] = [{"source": {"namespace": "file.object", "value": "a/b"}, "content_id": c(0x304), "media_type": "application/x-hdf5"}]
    out["observed_execution"] = [{"operation": f"{ns}:operation/validate", "implementation": "test", "hardware": None}]
    return out


def valid(document: dict) -> dict:
    """The document as its own reader gives it back."""
    from ..functions.ident import canonical_json

    return read(canonical_json(document).encode())
