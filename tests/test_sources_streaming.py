"""Containers and the store against hand-made files; the streamed subscription against its batch twin and fixed verdicts."""

import os
import random

import pytest

from brindle.functions.blake3 import blake3
from brindle.sources import container as C
from brindle.sources import store
from brindle.streaming import subscription as S

FMT = C.Format(b"TESTBOX2", b"TESTIDX\0", b"TESTGEN\0")
ROOT, REF = blake3(b"root"), blake3(b"ref")


def test_round_trip_and_equal_payloads_once():
    made = C.encode(FMT, b'{"a":1}', ROOT, [REF, REF], [b"one", b"", b"two" * 1000, b"one"])
    found = C.parse(FMT, made)
    assert (found["root_id"], found["references"], found["document"]) == (ROOT, [REF], '{"a":1}')
    assert sorted(f["data"] for f in found["frames"]) == [b"", b"one", b"two" * 1000]
    assert [f["content_id"] for f in found["frames"]] == sorted(f["content_id"] for f in found["frames"])


def test_every_changed_or_missing_byte_is_found():
    made = C.encode(FMT, b"{}", ROOT, [REF], [b"payload"])
    free = set(range(32, 40)) | set(range(44, 56))  # optional capabilities and bounds are not digested
    for at in set(range(len(made))) - free:
        broken = bytearray(made)
        broken[at] ^= 0x55
        with pytest.raises(C.ContainerError):
            C.parse(FMT, bytes(broken))
    for n in (0, 127, 128, len(made) - 1):
        with pytest.raises(C.ContainerError):
            C.parse(FMT, made[:n])


def test_generations_append_only():
    zero = C.start_generations(FMT, C.encode(FMT, b"{}", ROOT))
    one = C.append_generation(FMT, zero, b'{"b":2}', REF)
    two = C.append_generation(FMT, one, b'{"b":3}', ROOT)
    assert zero[128:] == two[128 : len(zero)] and [g["generation"] for g in C.generations(FMT, two)] == [2, 1, 0]
    found = C.parse(FMT, two)
    assert (found["generation"], found["document"], found["root_id"]) == (2, '{"b":3}', ROOT)
    with pytest.raises(C.ContainerError):
        C.generations(FMT, two, most=2)
    torn = bytearray(two)
    torn[88:96] = one[88:96]
    with pytest.raises(C.ContainerError):
        C.parse(FMT, bytes(torn))


def test_directory_of_containers(spark, tmp_path):
    rows = [(bytearray(blake3(bytes([i]))), f'{{"i":{i}}}', None, [bytearray(b"x" * i)] if i else None) for i in range(4)]
    datasets = spark.createDataFrame(rows, "root_id binary, document string, references array<binary>, payloads array<binary>")
    for i, r in enumerate(C.encode_containers(datasets, FMT).collect()):
        (tmp_path / f"f{i}").write_bytes(r["artifact"])
    (tmp_path / "bad").write_bytes(b"nothing")
    found = C.read_containers(spark, str(tmp_path), FMT, payloads=True)
    assert sorted((r["document"] or "", r["error"] is None) for r in found.collect()) == [("", False)] + [(f'{{"i":{i}}}', True) for i in range(4)]
    assert sorted(bytes(r["data"]) for r in C.frame_rows(found).collect()) == [b"x", b"xx", b"xxx"]
    assert all(r["data"] is None for r in C.frame_rows(C.read_containers(spark, str(tmp_path), FMT)).collect())


def test_store(spark):
    stored = spark.createDataFrame([("a", 1)], "k string, n int")
    arriving = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6)], "k string, n int")
    assert [tuple(r) for r in store.new_objects(stored, arriving, "k", "n").collect()] == [("b", 6)]
    objects = spark.createDataFrame([(n,) for n in "pqrx"], "node string")
    edges = spark.createDataFrame([("p", "q"), ("q", "p"), ("r", "x"), ("x", "gone")], "src string, dst string")
    pins = spark.createDataFrame([(n,) for n in ("p", "r", "nowhere")], "node string")
    assert dict(map(tuple, store.pinnable(pins, objects, edges).collect())) == {"p": True, "r": False, "nowhere": False}
    assert sorted(r[0] for r in store.export_closure(pins.where("node = 'p'"), objects, edges).collect()) == ["p", "q"]


def brute(rows):
    length, mark, known, out = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        sub, seq, logical, gen, snap, water, pg, ps = r
        old = known.get((sub, logical))
        corrects = pg is not None or ps is not None
        if seq != length.get(sub, 0):
            v = "sequence"
        elif sub in mark and water < mark[sub]:
            v = "watermark"
        elif old is None:
            v = "unknown-correction" if corrects else None if gen == 0 else "generation"
        else:
            v = None if corrects and (pg, ps) == old and gen == old[0] + 1 else "generation"
        if v is None:
            length[sub], mark[sub], known[sub, logical] = seq + 1, water, (gen, snap)
        out[sub, snap] = v
    return out


def snapshots():
    rng, rows = random.Random(5), []
    for sub in range(20):
        known, water = {}, 0
        for seq in range(12):
            logical, water = f"l{rng.randrange(4)}", water + rng.randrange(3)
            old = known.get(logical)
            gen, snap = (old[0] + 1 if old else 0), f"s{sub}-{seq:02}"
            row = [f"u{sub}", seq, logical, gen, snap, water, old[0] if old else None, old[1] if old else None]
            known[logical] = (gen, snap)
            if sub % 2 and rng.random() < 0.12:
                at = rng.choice([1, 3, 5, 6])
                row[at] = (row[at] or 0) + (-5 if at == 5 else 1)
            rows.append(tuple(row))
    return rows


def test_subscription_stream_and_batch_agree(spark, tmp_path):
    rows = snapshots()
    want = brute(rows)
    first = {}
    for (sub, snap), v in want.items():
        if v and sub not in first:
            first[sub] = v
    df = spark.createDataFrame(rows, S.SNAPSHOT)
    assert {r["subscription_id"]: r["violation"] for r in S.first_violations(df).collect()} == first
    assert {r[0] for r in S.sealed(df).collect()} == {r[0] for r in rows} - set(first)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part, test in ((0, "sequence < 6"), (1, "sequence >= 6")):
            df.where(test).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = S.check_stream(spark.readStream.schema(S.SNAPSHOT).parquet(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["subscription_id"], r["snapshot_id"]): r["violation"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(rows)
    clean = {k: v for k, v in want.items() if k[0] not in first}
    assert {k: got[k] for k in clean} == clean and {s: next((got[k] for k in sorted(got) if k[0] == s and got[k]), None) for s in first} == first


def test_generation_sink(spark, tmp_path):
    from brindle.model import build, document
    from brindle.streaming import generations as G

    made = lambda n: document.debug_json(build.empty(f"{n:032x}"))
    rows = [("a", 0, made(1)), ("b", 0, made(2)), ("a", 1, made(3)), ("a", 2, made(1)), ("b", 1, made(2))]
    source, out = tmp_path / "in", tmp_path / "out"
    out.mkdir()
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], "name string, sequence long, document string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("name string, sequence long, document string").option("maxFilesPerTrigger", 1).json(str(source))
    G.generation_sink(stream, str(out), FMT).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    a, b = ((out / f"{n}{G.SUFFIX}").read_bytes() for n in "ab")
    assert [len(C.generations(FMT, x)) for x in (a, b)] == [3, 1] and C.parse(FMT, a)["document"] == made(1)
    again = G.append_datasets(spark.createDataFrame(rows[3:], "name string, sequence long, document string"), str(out), FMT)
    assert {r["name"]: (r["new"], r["generations"]) for r in again.collect()} == {"a": (0, 3), "b": (0, 1)}
    assert sorted(os.listdir(out)) == [f"a{G.SUFFIX}", f"b{G.SUFFIX}"]
