"""Typed files, their published digests, encryption, adapters and the store."""

import copy
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.ident import Names, canonical_json
from brindle.model import build, document
from brindle.sources import adapters as A
from brindle.sources import bundles as B
from brindle.sources import cipher, profiles, store
from brindle.sources import container as C
from brindle.training import records as R

from . import published

FMT = C.Format(b"TESTBOX2", b"TESTIDX\0", b"TESTGEN\0")


def published_format(suffix):
    """The format of the published files: their family is the suffix of their names."""
    names, upper = published.names(), suffix.upper().encode()
    return C.Format(names.concept.upper().encode() + upper, upper + b"IDX\0", upper + b"GEN\0", names, suffix)


def tree_entries():
    e = B.entry
    copy_of = dict(hardlink_target=b"source/raw.edf")
    return sorted([e(b"source", "directory"), e(b"source/raw.edf", "regular", 0o640, b"EDF fixture bytes"), e(b"source/raw-copy.edf", "hardlink", 0o640, **copy_of), e(b"source/raw-current.edf", "symlink", 0o777, symlink_target=b"raw.edf")], key=lambda x: x["path"])


def test_published_files():
    vectors = {v["name"].split(".")[0]: v for _, found in published.manifests() if not any("catalog" in v for v in found) for v in found}
    fmt = published_format(next(iter(vectors.values()))["name"].rsplit(".", 1)[1])
    first, second = build.empty("21" * 16), build.empty("22" * 16)
    plain = B.encode_dataset(fmt, first)
    root = bytes.fromhex(document.identities([second], "logical", fmt.names)[0])
    made = {
        "dataset": plain, "forensic-image": B.encode_blob(fmt, fmt.names.concept.upper().encode() + b" forensic image\0\x01", "application/octet-stream"), "forensic-tree": B.encode_tree(fmt, "linux", tree_entries()),
        "generational-dataset": C.append_generation(fmt, C.start_generations(fmt, plain), document.debug_json(second).encode(), root), "encrypted-discoverable": B.encrypt(fmt, plain, b"\x42" * 32, b"\x24" * 24, True),
    }
    assert set(made) == set(vectors)
    for name, v in vectors.items():
        assert (len(made[name]), hashlib.sha256(made[name]).hexdigest()) == (v["bytes"], v["sha256"]), name
    assert C.parse(fmt, made["generational-dataset"])["root_id"].hex() == vectors["generational-dataset"]["root_content_id"]


def test_published_codec_catalogs():
    at, vectors = next((at, found) for at, found in published.manifests() if any("catalog" in v for v in found))
    fmt = published_format(vectors[0]["name"].rsplit(".", 1)[1])
    codecs = {v["name"].split(".")[0]: code for v, code in zip(vectors, (profiles.LOSSLESS, profiles.PROGRESSIVE), strict=True)}
    for v in vectors:
        text = (at / v["catalog"]).read_bytes().rstrip(b"\n")
        B.check_codec_catalog(fmt, json.loads(text), codecs)
        assert canonical_json(json.loads(text)).encode() == text and B.codec_root(fmt, text).hex() == v["root_content_id"]


def test_cipher():
    """The published example of the extended-nonce construction, and every changed byte."""
    key, nonce, more = bytes(range(0x80, 0xA0)), bytes(range(0x40, 0x58)), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = cipher.seal(key, nonce, text, more)
    assert sealed[:16].hex() == "bd6d179d3e83d43b9576579493c0e939" and sealed[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    assert cipher.open_sealed(key, nonce, sealed, more) == text
    for at in range(len(sealed)):
        broken = bytearray(sealed)
        broken[at] ^= 1
        with pytest.raises(cipher.AuthenticationError):
            cipher.open_sealed(key, nonce, bytes(broken), more)
    with pytest.raises(cipher.AuthenticationError):
        cipher.open_sealed(key, nonce, sealed, more + b"x")
    assert cipher.open_sealed(key, nonce, cipher.seal(key, nonce, b"")) == b""


@pytest.mark.parametrize("discoverable", [True, False])
def test_encrypted_envelopes(discoverable):
    plain = B.encode_dataset(FMT, build.empty("01" * 16))
    key, nonce = bytes(range(32)), bytes(24)
    sealed = B.encrypt(FMT, plain, key, nonce, discoverable)
    told = B.parse_envelope(FMT, sealed)
    assert (told["root_id"] == C.parse(FMT, plain)["root_id"]) == discoverable and (told["profile"] is None) != discoverable
    assert B.decrypt(FMT, sealed, key) == plain
    for at in random.Random(1).sample(range(len(sealed)), 120):
        broken = bytearray(sealed)
        broken[at] ^= 0x11
        with pytest.raises(C.ContainerError):
            B.decrypt(FMT, bytes(broken), key)
    with pytest.raises(C.ContainerError, match="authentication"):
        B.decrypt(FMT, sealed, bytes(32))


def test_blobs():
    for data, media in ((b"", "a/b"), (b"x" * 5000, "application/octet-stream")):
        found = B.parse_blob(FMT, B.encode_blob(FMT, data, media))
        assert (found["data"], found["media_type"]) == (data, media)
    for media in ("text", "a/b/c", "/b", "a/", "a b/c", "é/b", "a/" + "b" * 128, "a/b\n"):
        with pytest.raises(C.ContainerError):
            B.encode_blob(FMT, b"", media)
    with pytest.raises(C.ContainerError):
        B.parse_blob(FMT, B.encode_tree(FMT, "linux", tree_entries()))


def test_trees():
    entries = [*tree_entries(), B.entry(b"z.bin", "regular", 0o600, b"ab\0\0cd", sparse=[[0, 2, False], [2, 2, True], [4, 2, False]], xattrs=[[b"user.a", b"1"], [b"user.b", b""]], timestamps=[[1, 5], None, [-3, 0], None], owner=[0, 1000], acl=b"x", flags=3)]
    made = B.encode_tree(FMT, "linux", entries)
    found = B.parse_tree(FMT, made)
    assert [e["path"] for e in found["entries"]] == [e["path"] for e in entries] and found["entries"][-1]["content"] == b"ab\0\0cd" and found["entries"][-1]["timestamps"] == [[1, 5], None, [-3, 0], None]


TREE_FAULTS = [
    lambda e: e.reverse(), lambda e: e[0].update(path=b"/source"), lambda e: e[0].update(path=b"other"), lambda e: e[1].update(mode=0o600), lambda e: e[1].update(hardlink_target=b"source/none"), lambda e: e[2].update(content=b"x"),
    lambda e: e[3].update(content=None), lambda e: e[3].update(sparse=[[0, 3, False], [4, 13, True]]), lambda e: e[3].update(sparse=[[0, 3, False]]), lambda e: e[2].update(symlink_target=b""), lambda e: e[0].update(device=[1, 2]),
    lambda e: e[3].update(timestamps=[[0, 10**9], None, None, None]), lambda e: e[3].update(xattrs=[[b"b", b""], [b"a", b""]]), lambda e: e[0].update(type="unknown"), lambda e: e[0].update(path=b"source/../x"), lambda e: e[3].update(mode=1 << 32),
]


@pytest.mark.parametrize("n", range(len(TREE_FAULTS)))
def test_faulty_trees(n):
    entries = copy.deepcopy(tree_entries())
    TREE_FAULTS[n](entries)
    with pytest.raises(C.ContainerError):
        B.encode_tree(FMT, "linux", entries)


def test_restore(tmp_path):
    entries = [*tree_entries(), B.entry(b"z.bin", "regular", 0o600, b"ab\0\0cd", sparse=[[0, 2, False], [2, 2, True], [4, 2, False]])]
    tree = B.parse_tree(FMT, B.encode_tree(FMT, "linux", entries))
    for exact in (False, True):
        at = tmp_path / str(exact)
        at.mkdir()
        assert B.restore(tree, str(at), exact) == {"entries": 5, "omissions": []}
        assert (at / "source/raw-copy.edf").read_bytes() == b"EDF fixture bytes" and os.stat(at / "source/raw.edf").st_nlink == 2
        assert os.readlink(at / "source/raw-current.edf") == "raw.edf" and (at / "z.bin").read_bytes() == b"ab\0\0cd"
    assert os.stat(at / "source/raw.edf").st_mode & 0o777 == 0o640
    with pytest.raises(C.ContainerError, match="empty"):
        B.restore(tree, str(at))
    with pytest.raises(C.ContainerError, match="platform"):
        B.restore_plan(tree | {"platform": "other"}, True)
    owned = copy.deepcopy(tree)
    owned["entries"][3]["owner"] = [1, 1]
    assert B.restore_plan(owned, False)[1] == [(b"source/raw.edf", "ownership")]
    with pytest.raises(C.ContainerError, match="ownership"):
        B.restore_plan(owned, True)
    outside = copy.deepcopy(tree)
    outside["entries"][2]["symlink_target"] = b"../../etc"
    with pytest.raises(C.ContainerError, match="path"):
        B.restore_plan(outside, False)
    with pytest.raises(C.ContainerError, match="unsupported node"):
        B.restore_plan(tree | {"entries": [B.entry(b"p", "fifo")]}, False)


SEMANTICS = document.debug_json(build.valid(build.sample())).encode()
MADE = {"build_id": "b", "kernel_id": "k", "implementation_id": "31" * 32}
EXACT = {"bound": None, "contract_id": "32" * 32, "kind": "exact", "metric": None}
MODEL = {"checkpoint_content_id": "33" * 32, "checkpoint_sha256": "34" * 32, "pccp_change_id": "c1", "pccp_evidence_id": "35" * 32, "pccp_status": "candidate"}
BOUNDED = {"bound": {"type": "rational", "numerator": "-1", "denominator": "2"}, "contract_id": "32" * 32, "kind": "bounded", "metric": "error"}


def codec(**change):
    given = {"semantics": SEMANTICS, "packets": [b"one", b"two", b"one"], "profile": "lossless", "fidelity": EXACT, "implementation": MADE, "parameters": [{"name": "b", "value": {"type": "integer", "value": "8"}}, {"name": "a.x", "value": {"type": "boolean", "value": True}}]} | change
    return B.encode_codec_bundle(FMT, **given)


def test_codec_bundles():
    found = B.parse_codec_bundle(FMT, codec())
    assert found["packets"] == [b"one", b"two", b"one"] and found["semantics"] == SEMANTICS and [p["name"] for p in found["catalog"]["parameters"]] == ["a.x", "b"]
    found = B.parse_codec_bundle(FMT, codec(profile="progressive", fidelity=BOUNDED, model_provenance=MODEL))
    assert found["catalog"]["model_provenance"] == MODEL


CODEC_FAULTS = [
    ({"packets": []}, "codec catalog"), ({"packets": [b""]}, "packet order"), ({"packets": [SEMANTICS]}, "duplicate frame"), ({"semantics": b" " + SEMANTICS}, "not canonical"), ({"profile": "none"}, "codec profile"),
    ({"fidelity": BOUNDED}, "fidelity-mismatch"), ({"model_provenance": MODEL}, "model-provenance-forbidden"), ({"profile": "progressive", "fidelity": BOUNDED}, "model-provenance-required"),
    ({"profile": "progressive", "fidelity": EXACT, "model_provenance": MODEL}, "fidelity-mismatch"), ({"profile": "progressive", "fidelity": BOUNDED, "model_provenance": MODEL | {"checkpoint_sha256": "0" * 64}}, "incomplete-model"),
    ({"fidelity": EXACT | {"metric": "x"}}, "fidelity-mismatch"), ({"profile": "progressive", "fidelity": BOUNDED | {"kind": "transformed"}, "model_provenance": MODEL}, "fidelity-mismatch"), ({"implementation": MADE | {"build_id": " b"}}, "implementation"),
    ({"implementation": MADE | {"implementation_id": "0" * 64}}, "incomplete identity"), ({"parameters": [{"name": "A", "value": {"type": "boolean", "value": True}}]}, "parameter"), ({"parameters": [{"name": "a", "value": {"type": "integer", "value": "08"}}]}, "parameter"),
    ({"parameters": [{"name": "a", "value": {"type": "integer", "value": "-0"}}]}, "parameter"), ({"parameters": [{"name": "a", "value": {"type": "bytes", "hex": "A0"}}]}, "parameter"), ({"parameters": [{"name": "a", "value": {"type": "rational", "numerator": "1", "denominator": "0"}}]}, "parameter"),
    ({"parameters": [{"name": "a", "value": {"type": "text", "value": "\x85"}}]}, "parameter"), ({"parameters": [{"name": "a", "value": {"type": "text", "value": "x"}}] * 2}, "parameter"),
]


@pytest.mark.parametrize("change,message", CODEC_FAULTS)
def test_faulty_codec_bundles(change, message):
    with pytest.raises(ValueError, match=message):
        codec(**change)


def dataset_with_payloads():
    import numpy as np

    ids = {"dataset": "0" * 31 + "1", "recording": "0" * 31 + "2", "stream": "0" * 31 + "3", "atom": "0" * 31 + "4", "clock": "0" * 31 + "6"}
    found, data = build.from_tensor(np.arange(5, dtype=np.int16), ids, "a:b", (1, 1))
    found = build.valid(found)
    return found, {found["atoms"][0]["payload"]["content_id"]: ("i16", data)}


def test_datasets_with_payloads():
    dataset, payloads = dataset_with_payloads()
    found = C.parse(FMT, B.encode_dataset(FMT, dataset, payloads=payloads))
    assert [(f["kind"], document.ELEMENTS[f["element"] - 1], f["data"]) for f in found["frames"]] == [(C.SEMANTIC, *next(iter(payloads.values())))]
    assert document.is_canonical(found["document"].encode(), dataset)
    (key, (element, data)), = payloads.items()
    for wrong, message in (({}, "missing payload"), (payloads | {"aa" * 32: ("u8", b"")}, "extra payload"), ({key: (element, data[:-1])}, "descriptor"), ({key: ("u16", data)}, "descriptor"), ({key: (element, data[::-1])}, "identity")):
        with pytest.raises(C.ContainerError, match=message):
            B.encode_dataset(FMT, dataset, payloads=wrong)


def snapshot(n=2):
    names = Names()
    data = [bytes([i, 0, i, 1]) for i in range(n)]
    ids = [C.semantic_frame(FMT, "i16", d)[0].hex() for d in data]
    rows = [{"byte_order": "little", "element": "i16", "group": "11" * 32, "label": "12" * 32, "logical_bytes": 4, "logical_id": f"{i:064x}", "payload": ids[i], "shape": [2], "split": "13" * 32} for i in range(n)]
    return R.seal_snapshot(["01" * 32], "02" * 32, "compact", rows, "03" * 32, names=names), [("i16", d) for d in data]


def test_training_stores():
    made, frames = snapshot()
    data = B.encode_store(FMT, made, frames)
    found = B.open_store(FMT, data)
    assert found["snapshot"] == made and found["snapshot_id"] == R.snapshot_id(made)
    assert all(data[at : at + n] == found["payloads"][key] for key, (at, n) in found["places"].items())
    receipt = R.execute(made, found["payloads"], data, "bytes")
    assert receipt["row_count"] == 2 and receipt["physical_artifact_sha256"] == hashlib.sha256(data).hexdigest()
    with pytest.raises(R.TrainingError, match="missing-payload"):
        B.encode_store(FMT, made, frames[:1])
    with pytest.raises(C.ContainerError):
        B.open_store(FMT, B.encode_dataset(FMT, build.empty("01" * 16)))


def test_packs(spark):
    sealed = lambda n, refs=(): C.encode(FMT, f'{{"n":{n}}}'.encode(), bytes([n]) * 32, [bytes([r]) * 32 for r in refs])
    objects = {bytes([n]) * 32: sealed(n, refs) for n, refs in ((2, (3,)), (3, (1,)))}
    root = sealed(1, (2,))
    packed = C.pack(FMT, root, objects)
    assert C.unpack(FMT, packed) == [*sorted(objects.items()), (bytes([1]) * 32, root)]
    with pytest.raises(C.ContainerError, match="incomplete"):
        C.pack(FMT, root, {k: v for k, v in objects.items() if k[0] == 2})
    with pytest.raises(C.ContainerError, match="extra"):
        C.pack(FMT, root, objects | {bytes([9]) * 32: sealed(9)})
    with pytest.raises(C.ContainerError, match="cannot embed"):
        C.pack(FMT, sealed(5, (1,)), {bytes([1]) * 32: packed})
    with pytest.raises(C.ContainerError, match="portable"):
        C.pack(FMT, C.encode(FMT, b"{}", bytes(32), profile=0x30001), {})
    rows = store.import_portable(spark.createDataFrame([(packed,), (packed[:-1] + b"x",)], "artifact binary"), FMT).collect()
    assert sorted((r.nth, r.content_id[:2]) for r in rows if r.error is None) == [(0, "02"), (1, "03"), (2, "01")] and sum(r.error is not None for r in rows) == 1


def test_roots_as_tables(spark):
    made, frames = snapshot()
    files = {"blob": B.encode_blob(FMT, b"abc", "a/b"), "tree": B.encode_tree(FMT, "linux", tree_entries()), "codec": codec(), "training": B.encode_store(FMT, made, frames), "encrypted": B.encrypt(FMT, B.encode_blob(FMT, b"", "a/b"), bytes(32), bytes(24), True)}
    df = spark.createDataFrame(list(files.items()), "path string, content binary").cache()
    counts = {"blob": 1, "tree": 4, "codec": 3, "training": 2, "encrypted": 1}
    for root, n in counts.items():
        rows = B.read_root(df, FMT, root).collect()
        assert sum(r.error is None for r in rows) == n and {r.file for r in rows if r.error is None} == {root} and sum(r.error is not None for r in rows) == 4
    containers = spark.createDataFrame([(0x10001, 1), (0x50002, 1), (7, 1)], "profile long, root_kind int")
    assert [r.accepted for r in profiles.with_profile(containers).orderBy("profile", ascending=False).collect()] == [False, True, False]


# adapters

PROFILE = A.Profile("box.1", "Box", "1", ("application/box",), "forensic", "checker", frozenset(A.CORE))
FILES = [A.File("b/x.bin", "application/box", b"123"), A.File("a.txt", None, b"")]


def registry(**change):
    row = {"id": "box.1", "standard": "Box", "edition": "1", "media_types": ["application/box"], "status": "forensic", "required_validator": "checker", "capabilities": sorted(A.CORE)} | change
    return {"schema_version": 1, "profiles": [row]}


def test_adapter_registry(spark):
    assert A.parse_registry(json.dumps(registry()).encode()) == {"box.1": PROFILE}
    faults = [{"id": ""}, {"media_types": []}, {"media_types": ["a b/c"]}, {"status": "stream"}, {"status": "hardware", "capabilities": sorted(A.CORE | {"hardware"})}, {"capabilities": ["inspect"]}, {"status": "x"}]
    for change in faults:
        with pytest.raises(A.AdapterError):
            A.parse_registry(json.dumps(registry(**change)).encode())
    with pytest.raises(A.AdapterError):
        A.parse_registry(json.dumps({"schema_version": 1, "profiles": registry()["profiles"] * 2}).encode())
    rows = [registry(**({"id": f"p{i}"} | f))["profiles"][0] for i, f in enumerate([{}, *faults])]
    table = spark.createDataFrame(rows, "id string, standard string, edition string, media_types array<string>, status string, required_validator string, capabilities array<string>")
    assert {r.id for r in A.registry_faults(table).collect()} == {r["id"] for r in rows[1:]}
    known = A.AdapterRegistry()
    known.register(A.ForensicAdapter(PROFILE, 100))
    known.declare_provider("other", "box-other")
    assert known.get("box.1").profile == PROFILE
    for call, code in ((lambda: known.register(A.ForensicAdapter(PROFILE, 1)), "invalid-source"), (lambda: known.declare_provider("other", "x"), "invalid-source"), (lambda: known.get("other"), "adapter-unavailable"), (lambda: known.get("z"), "adapter-unavailable")):
        with pytest.raises(A.AdapterError) as error:
            call()
        assert error.value.code == code
    with pytest.raises(A.AdapterError, match="box-other"):
        known.get("other")


def test_forensic_adapter():
    adapter = A.ForensicAdapter(PROFILE, 100)
    assert adapter.inspect("box.1", FILES)["logical_bytes"] == 3
    dataset, report, payloads = adapter.read("box.1", FILES)
    assert not report.first_class_semantic() and report.preserved_unknowns == 2 and len(payloads) == 2
    plan = adapter.plan_export(dataset)
    assert plan.accepts_without_loss()
    files, receipt = adapter.export(dataset, plan, payloads.__getitem__)
    assert sorted(files) == sorted(FILES) and receipt["exact_source_restoration"] and not receipt["semantic_equivalence"]
    assert adapter.validate("box.1", FILES) == {"profile": "box.1", "internal_valid": True, "independent_validator": "checker", "independent_valid": None, "diagnostics": []}
    assert not adapter.validate("box.1", [])["internal_valid"]
    for files_, profile, code in ((FILES, "x", "profile-mismatch"), ([], "box.1", "empty-source"), ([FILES[0]] * 2, "box.1", "duplicate-path"), ([A.File("x", None, b"1" * 101)], "box.1", "source-too-large"),
                                  *[([A.File(p, None, b"")], "box.1", "invalid-path") for p in ("", "/a", "a//b", "a/../b", "a\\b", "a\n", "a\x85")]):
        with pytest.raises(A.AdapterError) as error:
            adapter.inspect(profile, files_)
        assert error.value.code == code
    assert adapter.inspect("box.1", [A.File("./a", None, b"")])["entry_count"] == 1
    for changed, resolve, code in ((A.ExportPlan("x", "box.1", ()), payloads.__getitem__, "export-plan-mismatch"), (plan, lambda _: b"other", "missing-payload")):
        with pytest.raises(A.AdapterError) as error:
            adapter.export(dataset, changed, resolve)
        assert error.value.code == code
    empty = build.valid(build.empty("01" * 16))
    with pytest.raises(A.AdapterError, match="unsupported-meaning"):
        adapter.export(empty, adapter.plan_export(empty), payloads.__getitem__)


def test_adapter_tables(spark, tmp_path):
    rows = [("o1", f.path, f.media_type, f.data) for f in FILES] + [("o2", "a", None, b"1"), ("o2", "a", None, b"2"), ("o3", "x/../y", None, b""), ("o4", "big", None, b"1" * 50)]
    files = spark.createDataFrame(rows, "object string, path string, media_type string, data binary")
    got = {r.object: (r.entry_count, int(r.logical_bytes), r.fault) for r in A.inspect_files(files, 40).collect()}
    assert got == {"o1": (2, 3, None), "o2": (2, 2, "duplicate-path"), "o3": (1, 0, "invalid-path"), "o4": (1, 50, "source-too-large")}
    capsules = A.import_files(files.where("object = 'o1'"), "box.1")
    assert {r.value: r.content_id for r in capsules.collect()} == {f.path: A.payload_id(f.data) for f in FILES}
    back = A.export_files(capsules.drop("data"), capsules.where("value = 'a.txt'").select("content_id", "data"), "box.1")
    assert {r.path: r.state for r in back.collect()} == {"a.txt": "exact", "b/x.bin": "missing-payload"}
    (tmp_path / "b").mkdir()
    for f in FILES:
        (tmp_path / f.path).write_bytes(f.data + b"!")
    read = A.read_folder(spark, str(tmp_path), "o1")
    assert sorted((r.path, bytes(r.data)) for r in read.collect()) == sorted((f.path, f.data + b"!") for f in FILES)
    want = hashlib.sha256(b"core.adapter.fixture-tree.v1\0")
    for f in sorted(FILES):
        for part in (f.path.encode(), f.data):
            want.update(len(part).to_bytes(8, "big") + part)
    digests = {r.object: r.digest for r in A.tree_digest(files).collect()}
    assert digests["o1"] == want.hexdigest() and len(digests) == 4


# the store


def test_leases(spark):
    from brindle.functions.blake3 import blake3

    key = blake3(Names().payload("u8") + b"abc").hex()
    descriptors = spark.createDataFrame([(key, "u8", 3), (key, "u8", 4), (key, "i8", 3), ("0" * 64, "u8", 0)], "content_id string, element string, logical_bytes long")
    got = store.lease(descriptors, spark.createDataFrame([(key, b"abc")], "content_id string, data binary")).collect()
    assert sorted((r.element, r.logical_bytes, r.state, r.data is not None) for r in got) == [("i8", 3, "content", False), ("u8", 0, "missing", False), ("u8", 3, "ok", True), ("u8", 4, "length", False)]


def test_collection(spark):
    objects = spark.createDataFrame([("s1", "a", ["b"]), ("s2", "a", ["b"]), ("s3", "b", []), ("s4", "c", ["d"]), ("s5", "e", []), ("s6", "f", [])], "storage_id string, content_id string, references array<string>")
    pins = spark.createDataFrame([("a",), ("c",)], "node string")
    leased = spark.createDataFrame([("s6",)], "storage_id string")
    assert sorted(r.storage_id for r in store.collectable(objects, pins, leased).collect()) == ["s4", "s5"]
    with pytest.raises(store.StoreError):
        store.collectable(objects, pins, leased, "fail")
    assert sorted(r.storage_id for r in store.collectable(objects, pins.where("node = 'a'"), None, "fail").collect()) == ["s4", "s5", "s6"]
    assert {r.content_id: (r.storage_id, r.variants) for r in store.by_content(objects).collect()}["a"] == ("s1", 2)
    assert store.conflicting_closures(objects).count() == 0 and store.conflicting_closures(objects.unionByName(spark.createDataFrame([("s9", "a", ["x"])], objects.schema))).count() == 1


def test_folder_store(spark, tmp_path):
    made = [B.encode_blob(FMT, bytes([n]), "a/b") for n in range(3)]
    artifacts = spark.createDataFrame([(m,) for m in [*made, made[0]]], "artifact binary").coalesce(1)
    assert sorted(r.new for r in store.publish(artifacts, str(tmp_path), FMT).collect()) == [False, True, True, True]
    assert not any(r.new for r in store.publish(artifacts, str(tmp_path), FMT).collect())
    (tmp_path / (store.UNFINISHED + "x")).write_bytes(b"half")
    (tmp_path / ("0" * 64 + store.SUFFIX)).write_bytes(made[0])
    (tmp_path / ("1" * 64 + store.SUFFIX)).write_bytes(b"junk")
    found = store.open_folder(spark, str(tmp_path), FMT).collect()
    assert len(found) == 5 and sum(r.error is None for r in found) == 3 and sum(r.error == "the name is not the storage id" for r in found) == 1
    assert store.clean_folder(str(tmp_path)) == 1
    store.remove_objects(str(tmp_path), ["0" * 64, "1" * 64])
    assert all(r.error is None for r in store.open_folder(spark, str(tmp_path), FMT).collect())
    assert store.open_folder(spark, str(tmp_path), FMT).where(F.size("payloads") == 1).count() == 3
