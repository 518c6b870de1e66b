"""Dataset documents: reading, canonical forms, golden identities, and a failing document for every rule."""

import copy
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import blake3
from brindle.functions.ident import Names, blake3_hex, canonical_json, payload_id
from brindle.model import build, document, exact, rules, tables

from . import published

#: Published identities: logical, and interchange where one is given.
GOLDEN = {
    "6f8244472204b5ed25ebd67a1abd88e24f2addd6b152bb1857b27b78e7d02ebe": "35955e5a39ddeed771be1757a1bb79f345d6ea1c0311f742e93e1bf5200974d5",
    "5dc2c9afcdfa5c96fc15c3a6119cd5084183a2653326c88824ce6fd7a03f1456": None,
}


def i(n):
    return f"{n:032x}"


def test_blake3_vectors():
    """Published test vectors: input bytes 0, 1, ... 250, 0, 1, ...; and every length around blocks and chunks against itself in one batch."""
    data = bytes(k % 251 for k in range(31744))
    want = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"}
    for n, digest in want.items():
        assert blake3.blake3(data[:n]).hex() == digest
    assert blake3.derived("BLAKE3 2019-12-27 16:29:52 test vectors context", [b""])[0].hex() == "2cc39783c223154fea8dfb7c1b1660f2ac2dcbd1c1de8277b0b0dd39b7e50d7d"
    messages = [data[:n] for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 3073, 5121, 8193, 31744)] * 3
    one_by_one = [blake3.blake3(m) for m in messages]
    assert blake3.hash_many(messages) == one_by_one
    assert [blake3._small(m, blake3.IV, 0) for m in messages if len(m) <= 1024] == [h for m, h in zip(messages, one_by_one, strict=True) if len(m) <= 1024]


def test_hash_columns(spark):
    df = spark.createDataFrame([(b"a" * n, "i8") for n in (0, 5, 3000)] + [(None, "i8")], "b binary, e string")
    for r in df.select("b", blake3_hex(F.col("b")).alias("h"), payload_id(F.col("e"), F.col("b")).alias("p")).collect():
        assert r.h == (None if r.b is None else blake3.blake3(bytes(r.b)).hex())
        assert r.p == (None if r.b is None else blake3.blake3(Names().payload("i8") + bytes(r.b)).hex())


@pytest.mark.parametrize("logical", GOLDEN)
def test_published_identities(logical):
    data = published.documents()[logical]
    names, found = published.names(), document.read(data)
    assert document.is_canonical(data, found) and document.debug_json(found).encode() == data.rstrip(b"\n")
    assert document.identities([found], "logical", names) == [logical]
    assert GOLDEN[logical] in (None, document.identities([found], "interchange", names)[0])


def test_published_documents_are_valid(spark):
    names = published.names()
    files = spark.createDataFrame(list(published.documents().items()), "path string, content binary")
    t = tables.collections(tables.records(files).cache())
    assert rules.report(t, names=names).count() == 0
    assert 395 in {r.budget for r in rules.metadata_budget(t).collect()}


def test_order_and_storage_do_not_change_the_identity():
    whole = build.valid(build.sample())
    rng = random.Random(3)
    mixed = copy.deepcopy(whole)
    for name in document.COLLECTIONS:
        if name != "observed_execution":
            rng.shuffle(mixed[name])
    for a in mixed["atoms"]:
        if a["payload"] and isinstance(a["payload"]["layout"], str):
            a["payload"] |= {"layout": "dense-column-major", "byte_order": "big"}
    mixed["observed_execution"] = []
    assert document.identities([whole], "logical") == document.identities([mixed], "logical") != document.identities([whole], "interchange")
    mixed["source_capsules"] = []
    assert document.identities([whole], "interchange") == document.identities([mixed], "interchange") and document.identities([whole], "logical") != document.identities([mixed], "logical")
    mixed["atoms"][0]["id"] = i(0x999)
    assert document.identities([whole], "interchange") != document.identities([mixed], "interchange")


FAULTS = [
    ([], "expected object at $"),
    ({"semantic_version": "2"}, "expected semantic version 1 at $.semantic_version"),
    ({"dataset_id": "A" * 32}, "identifiers must use lower-case hexadecimal at $.dataset_id"),
    ({"dataset_id": "a"}, "expected 32 lower-case hexadecimal characters at $.dataset_id"),
    ({"subjects": None}, "expected array at $.subjects"),
    ({"subjects": [{"id": i(1), "kind": "a:b\n", "source_keys": []}]}, "concept identifier is not canonical at $.subjects[0].kind"),
    ({"subjects": [{"id": i(1), "kind": "a:b", "source_keys": [{"namespace": "x", "value": "\x85"}]}]}, "source key is invalid at $.subjects[0].source_keys[0]"),
    ({"subjects": [{"id": i(1), "kind": "a:b", "source_keys": [{"namespace": "", "value": ""}]}]}, "source key is invalid at $.subjects[0].source_keys[0]"),
    ({"source_relationships": [{"kind": "x"}]}, "unknown source relationship kind at $.source_relationships[0].kind"),
    ({"recordings": [{"streams": [7]}]}, "expected string at $.recordings[0].streams[0]"),
    ({"streams": [{"atoms": []}]}, "missing member id at $.streams[0]"),
    ({"atoms": [{"id": i(1), "presence": "present", "kind": "none"}]}, "unknown atom kind at $.atoms[0].kind"),
    ({"atoms": [{"id": i(1), "presence": "gone"}]}, "unknown presence state at $.atoms[0].presence"),
    ({"atoms": [{"id": i(1), "presence": "present", "kind": "signal-block", "time_axis": {}}]}, "unknown time axis at $.atoms[0].time_axis"),
    ({"atoms": [{"id": i(1), "presence": "present", "kind": "tensor", "axes": [{"semantic": "a:b", "extent": True}]}]}, "expected unsigned integer at $.atoms[0].axes[0].extent"),
    ({"atoms": [{"id": i(1), "presence": "present", "kind": "tensor", "axes": [{"semantic": "a:b", "extent": 1 << 64}]}]}, "expected unsigned integer at $.atoms[0].axes[0].extent"),
    ({"clocks": [{"id": i(1), "kind": "a:b", "offset": {"$rational": ["1", "0"]}}]}, "rational denominator is zero at $.clocks[0].offset"),
    ({"clocks": [{"id": i(1), "kind": "a:b", "offset": {"$rational": ["x", "1"]}}]}, "invalid i128 numerator at $.clocks[0].offset"),
    ({"clocks": [{"id": i(1), "kind": "a:b", "offset": {"$rational": ["1"]}}]}, "rational must contain numerator and denominator at $.clocks[0].offset"),
    ({"coordinate_frames": [{"transform": [{"$integer": "1"}]}]}, "expected exactly 16 transform values at $.coordinate_frames[0].transform"),
    ({"coordinate_frames": [{"transform": [{"$integer": str(1 << 127)}]}]}, "integer is outside i128 at $.coordinate_frames[0].transform[0]"),
    ({"fidelity": [{"kind": "near"}]}, "unknown fidelity kind at $.fidelity[0].kind"),
    ({"proofs": [{"id": i(1), "kind": "a:b", "subject": {"id": i(1), "kind": "x"}}]}, "unknown semantic reference kind at $.proofs[0].subject.kind"),
]


@pytest.mark.parametrize("change,message", FAULTS)
def test_faulty_documents(change, message):
    data = change if isinstance(change, list) else build.empty(i(1)) | change
    with pytest.raises(document.DocumentError) as error:
        document.read(json.dumps(data).encode())
    assert str(error.value) == message


def test_faulty_bytes():
    for data in (b"{", b"\xff", b'{"a": NaN}', b""):
        with pytest.raises(document.DocumentError, match="invalid JSON"):
            document.read(data)


def test_unknown_members_are_not_canonical():
    good = canonical_json(document.canonical(build.valid(build.sample())))
    assert document.is_canonical(good.encode(), document.read(good.encode()))
    more = json.dumps(json.loads(good) | {"other": 1}).encode()
    assert not document.is_canonical(more, document.read(more))
    spaced = json.dumps(json.loads(good), indent=1).encode()
    assert document.is_canonical(spaced, document.read(spaced))


def change(path, value, append=False):
    def apply(d):
        *way, last = path
        at = d
        for step in way:
            at = at[step]
        if append:
            at[last].append(value(at[last]) if callable(value) else value)
        else:
            at[last] = value(at[last]) if callable(value) else value

    return apply


Q = build.exact
NS = Names().concept
MISSING, CONTENT = i(0xDEAD), f"{0xDEAD:064x}"
LIMITS = rules.Limits(channels=2, nesting=3)
clock = lambda n, parent: {"id": i(n), "kind": "a:b", "parent_id": parent, "offset": Q(0), "rate": Q(1), "uncertainty": Q(0)}
frame = lambda n, parent: {"id": i(n), "kind": "a:b", "parent_id": parent, "transform": None, "uncertainty": Q(0)}
policy = lambda n, parent: {"id": i(n), "parent_id": parent, "restrictions": [f"{NS}:policy/research-only", f"{NS}:policy/no-export"]}


def chain(make, first, parents):
    return [make(first + k, i(first + p) if p is not None else None) for k, p in enumerate(parents)]


def extend(name, rows):
    return lambda d: d[name].extend(rows)


#: Faults by rule: a change of the valid document and the failures (code, path, related) it must give, in order.
BROKEN = [
    ("v4", change(["clocks"], lambda c: c[0], True), [("E001", "clocks", i(4))]),
    ("v4", lambda d: d["events"].extend([d["events"][0]] * 2), [("E001", "events", i(0x32))] * 2),
    ("v5", change(["source_relationships", 0, "patient_id"], MISSING), [("E002", "source_relationships[0]", None)]),
    ("v5", change(["source_relationships", 7, "recording_id"], MISSING), [("E002", "source_relationships[7]", None)]),
    ("v6", change(["source_relationships", 8, "position"], 2), [("E002", "source_relationships[8]", None)]),
    ("v6", change(["source_relationships", 8, "basis_id"], MISSING), [("E002", "source_relationships[8]", None)]),
    ("v7", change(["recordings", 0, "streams"], MISSING, True), [("E002", "recordings[0].streams", MISSING)]),
    ("v8", change(["streams", 0, "recording_id"], MISSING), [("E002", "streams[0].recording_id", MISSING)]),
    ("v8", change(["recordings", 0, "streams"], []), [("E002", "streams[0].recording_membership", i(3))]),
    ("v9", change(["streams", 0, "atoms"], MISSING, True), [("E002", "streams[0].atoms", MISSING)]),
    ("v10", change(["streams", 0, "clock_id"], MISSING), [("E006", "streams[0].clock_id", MISSING)]),
    ("v11", lambda d: d["streams"][0].update(channel_basis_id=MISSING, policy_id=i(0xBEEF)), [("E002", "streams[0].channel_basis_id", MISSING), ("E002", "streams[0].policy_id", i(0xBEEF))]),
    ("v12", change(["atoms", 0, "payload", "logical_bytes"], 15), [("E005", "atoms[0]", i(0x40))]),
    ("v12", change(["atoms", 0, "payload", "shape"], [2, 3]), [("E005", "atoms[0]", i(0x40))]),
    ("v12", change(["atoms", 0, "time_axis", "piecewise"], []), [("E005", "atoms[0]", i(0x40))]),
    ("v12", change(["atoms", 0, "payload", "element"], "utf8"), [("E005", "atoms[0]", i(0x40))]),
    ("v12", change(["atoms", 0, "presence"], "withheld"), [("E005", "atoms[0]", i(0x40))]),
    ("v12", change(["atoms", 14, "presence"], "present"), [("E005", "atoms[14]", i(0x60))]),
    ("v12", change(["atoms", 3, "columns"], lambda c: [c[0], c[0]]), [("E005", "atoms[3]", i(0x43))]),
    ("v12", change(["atoms", 4, "axes", 0, "extent"], 0), [("E005", "atoms[4]", i(0x44))]),
    ("v12", change(["atoms", 4, "payload", "layout", "bfp", "mantissa_bits"], 33), [("E005", "atoms[4]", i(0x44))]),
    ("v12", change(["atoms", 6, "decoded_semantics", "shape"], [1 << 32, 1 << 32]), [("E005", "atoms[6]", i(0x46))]),
    ("v12", change(["atoms", 7, "media_type"], "text/"), [("E005", "atoms[7]", i(0x47))]),
    ("v12", change(["atoms", 7, "payload", "shape"], [3, 1 << 63, 2]), [("E005", "atoms[7]", i(0x47))]),
    ("v13", change(["atoms", 2, "clock_id"], MISSING), [("E006", "atoms[2].clock_id", MISSING)]),
    ("v14", change(["atoms", 2, "payload", "layout", "ragged", "offsets"], CONTENT), [("E002", "atoms[2].payload.companion", None)]),
    ("v15", change(["atoms", 2, "payload", "layout", "ragged", "rows"], 3), [("E005", "atoms[2].payload.companion", i(0x42))]),
    ("v15", change(["atoms", 2, "payload", "layout", "ragged", "rows"], (1 << 64) - 1), [("E005", "atoms[2].payload.companion", i(0x42))]),
    ("v15", change(["atoms", 4, "payload", "layout", "bfp", "block_len"], 4), [("E005", "atoms[4].payload.companion", i(0x44))]),
    ("v15", lambda d: (d["atoms"][13]["payload"].update(element="f64"), None), [("E005", "atoms[1].payload.companion", i(0x41))]),
    ("v16", change(["clocks", 0, "rate"], Q(0)), [("E003", "clocks[0]", None)]),
    ("v16", change(["clocks", 1, "uncertainty"], Q(-1, 3)), [("E003", "clocks[1]", None)]),
    ("v17", change(["clocks", 1, "parent_id"], MISSING), [("E006", "clocks[1].parent_id", MISSING)]),
    ("v18", extend("clocks", chain(clock, 0x100, [1, 2, 1])), [("E006", "clocks[2].ancestry_cycle", i(0x101)), ("E006", "clocks[3].ancestry_cycle", i(0x101)), ("E006", "clocks[4].ancestry_cycle", i(0x102))]),
    ("v18", extend("clocks", chain(clock, 0x100, [1, 2, 3, None])), [("E012", "clocks[2].ancestry_depth", None)]),
    ("v19", lambda d: d["coordinate_frames"][0].update(uncertainty=Q(-1)), [("E003", "coordinate_frames[0].uncertainty", None)]),
    ("v19", change(["coordinate_frames", 1, "parent_id"], MISSING), [("E007", "coordinate_frames[1].parent_id", MISSING)]),
    ("v19", extend("coordinate_frames", chain(frame, 0x100, [0])), [("E007", "coordinate_frames[2].ancestry_cycle", i(0x100))]),
    ("v20", lambda d: d["clock_relations"][0].update(from_clock_id=MISSING, to_clock_id=MISSING), [("E006", "clock_relations[0].from_clock_id", MISSING), ("E006", "clock_relations[0].to_clock_id", MISSING)]),
    ("v20", lambda d: d["clock_relations"][0].update(rate=Q(-1), validity_end=Q(-1, 10**30)), [("E003", "clock_relations[0]", None), ("E003", "clock_relations[0].validity", None)]),
    ("v21", lambda d: d["frame_transforms"][0].update(to_frame_id=MISSING, uncertainty=Q(-1)), [("E007", "frame_transforms[0].to_frame_id", MISSING), ("E003", "frame_transforms[0].uncertainty", None)]),
    ("v22", lambda d: d["events"][0].update(clock_id=MISSING, end=Q(49999, 100000)), [("E006", "events[0].clock_id", MISSING), ("E003", "events[0].interval", None)]),
    ("v23", change(["derived_artifacts", 0, "derivation_id"], MISSING), [("E002", "derived_artifacts[0].derivation_id", MISSING)]),
    ("v23", change(["derivations", 0, "outputs"], []), [("E002", "derived_artifacts[0].derivation_output", i(0x33))]),
    ("v24", change(["channel_bases", 0, "channels"], lambda c: c[1], True), [("E012", "channel_bases[0].channels", None)]),
    ("v25", change(["channel_bases", 0, "channels", 1, "coordinate_frame_id"], MISSING), [("E007", "channel_bases[0].channels[1].coordinate_frame_id", MISSING)]),
    ("v26", change(["policies", 1, "parent_id"], MISSING), [("E002", "policies[1].parent_id", MISSING)]),
    ("v26", change(["policies", 1, "restrictions"], [f"{NS}:policy/no-export"]), [("E010", "policies[1].restrictions", None)]),
    ("v27", extend("policies", chain(policy, 0x100, [1, 0])), [("E010", "policies[2].ancestry_cycle", None), ("E010", "policies[3].ancestry_cycle", None)]),
    ("v27", extend("policies", chain(policy, 0x100, [1, 2, 3, None])), [("E012", "policies[2].ancestry_depth", None)]),
    ("v28", change(["proofs", 0, "subject"], {"kind": "clock", "id": i(9)}), [("E002", "proofs[0].subject", None)]),
    ("v28", change(["proofs", 0, "subject"], {"kind": "clock", "id": i(4)}), [("E009", "proofs[0]", None)]),
    ("v28", lambda d: d["proofs"][0].update(kind=f"{NS}:proof/other", subject={"kind": "dataset", "id": i(1)}), []),
    ("v29", lambda d: d["derivations"][0]["inputs"].extend([{"kind": "stream", "id": MISSING}] * 2), [("E002", "derivations[0]", None)] * 2),
    ("v30", change(["fidelity", 0, "subject"], {"kind": "atom", "id": MISSING}), [("E002", "fidelity[0].subject", None)]),
    ("v30", change(["fidelity", 0, "metric"], "a:b"), [("E004", "fidelity[0]", None)]),
    ("v30", change(["fidelity", 1, "bound"], None), [("E004", "fidelity[1]", None)]),
    ("v30", lambda d: d["fidelity"][0].update(kind="transformed"), [("E004", "fidelity[0]", None)]),
]


@pytest.fixture(scope="module")
def broken(spark):
    rows = [("valid", canonical_json(build.sample()))]
    for n, (rule, apply, _) in enumerate(BROKEN):
        d = copy.deepcopy(build.sample())
        apply(d)
        rows.append((f"{rule}-{n}", canonical_json(d)))
    files = spark.createDataFrame([(k, v.encode()) for k, v in rows], "path string, content binary").repartition(4)
    assert tables.read_documents(files).where("error_message is not null").count() == 0
    t = tables.collections(tables.records(files).cache())
    found = {}
    for r in rules.ordered(rules.report(t, LIMITS)).orderBy("dataset", "nth").collect():
        found.setdefault(r.dataset, []).append(r)
    return t, found


def test_valid_document(broken):
    assert "valid" not in broken[1]


@pytest.mark.parametrize("n", range(len(BROKEN)), ids=lambda n: f"{BROKEN[n][0]}-{n}")
def test_every_rule(broken, n):
    rule, _, want = BROKEN[n]
    got = broken[1].get(f"{rule}-{n}", [])
    assert [(r.code, r.path, r.related) for r in got if r.rule == rule] == want
    assert {r.rule for r in got} <= {rule, "v12", "v14", "v29", "v23"} if want else not got


def test_limits(broken):
    t = broken[0]
    small = rules.Limits(recordings=0, streams=0, atoms=18, catalog_records=8, source_relationships=8, governance_records=6, metadata_bytes=100)
    got = [r.path for r in rules.ordered(rules.report(t, small, only=("v1", "v2", "v3"))).where("dataset = 'valid'").orderBy("nth").collect()]
    assert got == ["recordings", "streams", "atoms", "metadata_bytes", "catalog_records", "source_relationships", "governance_records"]


def test_failure_records_and_proofs(spark, broken):
    record = rules.failure_record(rules.report(broken[0], LIMITS, only=("v30",))).first()
    assert (record.severity, record.origin, record.retry_class) == ("error", "validation", "after-correction")
    subject = F.struct(F.lit("policy").alias("kind"), F.lit("x").alias("id"))
    told = spark.range(1).select(rules.satisfies(F.lit("a:b"), subject, F.lit("a:b"), subject), rules.satisfies(F.lit("a:b"), subject, F.lit("a:c"), subject), rules.misused(F.lit(f"{NS}:proof/derivation"), F.lit("policy"), Names()), rules.misused(F.lit("a:proof/derivation"), F.lit("policy"), Names()))
    assert tuple(told.first()) == (True, False, True, False)


def test_views(broken):
    t = broken[0]
    wanted = t["datasets"].where("dataset = 'valid'").select("dataset", F.explode(F.array(F.lit(i(0x40)), F.lit(i(0x42)), F.lit(MISSING))).alias("id"))
    states = {r.id: r.state for r in tables.atom_view(t, wanted, "signal-block").collect()}
    assert states == {i(0x40): "found", i(0x42): "wrong-kind", MISSING: "missing"}
    counts = {r.collection: r.n for r in tables.family_counts(t).where("dataset = 'valid'").collect()}
    assert counts["atoms"] == 19 and counts["clocks"] == 2 and len(counts) == len(document.COLLECTIONS)
    closure = sorted(r.content_id for r in tables.payload_closure(t).where("dataset = 'valid'").collect())
    assert closure == document.payload_ids(build.valid(build.sample()))


def test_exact_numbers():
    assert exact.reduced(-6, -4) == (3, 2) and exact.reduced(0, -7) == (0, 1)
    for n, d in ((1, 0), (1, exact.LEAST), (exact.LEAST, -1)):
        with pytest.raises(exact.ExactError):
            exact.reduced(n, d)
    assert exact.order((1, 3), (333333333333, 10**12)) == 1 and exact.order((exact.MOST, 1), (exact.MOST, 2)) == 1
    assert exact.sample_count({"piecewise": [{"samples": exact.UNSIGNED}, {"samples": 1}]}) is None and exact.sample_count({"piecewise": []}) is None


def test_decoding():
    for element, dtype in build.DTYPES.items():
        array = np.arange(6).reshape(2, 3).astype(dtype)
        for order, mark in (("little", "<"), ("big", ">")):
            data = array.astype(array.dtype.newbyteorder(mark)).tobytes()
            assert (build.decode(data, element, order, [2, 3]) == array).all()
    assert build.decode(b"\xff\xff\xff\x01\x00\x80", "i24", "little", [2]).tolist() == [-1, -8388607]
    assert build.decode(b"\xff\xff\xfe", "i24", "big", [1]).tolist() == [-2]
    assert build.decode(bytes([0, 1, 2, 3, 4, 5]), "u8", "not-applicable", [2, 3], "dense-column-major").tolist() == [[0, 2, 4], [1, 3, 5]]
    with pytest.raises(ValueError):
        build.decode(b"a", "utf8", "not-applicable", [1])


def test_tensor_builder():
    found, data = build.from_tensor(np.array([1, -2, 3], np.int16), {"dataset": i(1), "recording": i(2), "stream": i(3), "atom": i(4), "clock": i(6)}, "a:b", (256, 1))
    described = build.valid(found)["atoms"][0]["payload"]
    assert build.decode(data, described["element"], described["byte_order"], described["shape"]).tolist() == [1, -2, 3]
    assert described["content_id"] == blake3.blake3(Names().payload("i16") + data).hex()
    with pytest.raises(ValueError):
        build.from_tensor(np.array(["a"]), {}, "a:b", (1, 1))
