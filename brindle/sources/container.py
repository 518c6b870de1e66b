"""Content-addressed containers: envelope, catalog, frames, frame index and hash-linked generation footers.

Magics and the namespace of the hash domains come in a Format, so that one reader serves every family of such files. Parsing and writing are
pure functions of one file's bytes; Spark deals files to tasks. A file must fit in a row (2 GB at most, the limit of binaryFile).
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blake3 import blake3, hash_many
from ..functions.ident import Names
from ..model.document import ELEMENTS
from . import profiles

#: Sizes of the envelope, an index head, an index entry and a footer; frame kinds; storage contracts.
ENVELOPE, INDEX_HEAD, INDEX_ENTRY, FOOTER = 128, 48, 128, 160
EMBEDDED, RAW, SEMANTIC = 1, 2, 3
SEALED, GENERATIONAL = 1, 2
MAJOR, MINOR, SEMANTIC_GENERATION, BLAKE3_256 = 2, 0, 1, 1
PLAINTEXT, OPAQUE, DISCOVERABLE = 1, 2, 3
ENVELOPE_FIELDS = struct.Struct("<8sHHIIIQQBBBBIIIQQQQQ32s")
FOOTER_FIELDS = struct.Struct("<8sHHIQQ32sQQQQ32s32s")


class Format(NamedTuple):
    """The magics of a family of files, the namespace of its identities, and the name of the family in their domains."""

    magic: bytes
    index_magic: bytes
    footer_magic: bytes
    names: Names = Names()
    family: str = "container"
    known: dict[bytes, bytes] = {}  # hashes of messages that were computed together beforehand

    def hash(self, message: bytes) -> bytes:
        return self.known.get(message) or blake3(message)

    def knowing(self, messages: Iterable[bytes]) -> Format:
        """The format with the hashes of all messages, computed side by side."""
        distinct = list(dict.fromkeys(messages))
        return self._replace(known=dict(zip(distinct, hash_many(distinct), strict=True)))

    def frame_messages(self, data: bytes) -> list[bytes]:
        """What is hashed for a raw frame."""
        return [data, self.domain("raw-content") + data, self.domain("raw-storage") + data]

    def domain(self, what: str) -> bytes:
        return self.names.of(f"{self.family}.{what}")

    def storage_id(self, data: bytes) -> bytes:
        return self.hash(self.domain("storage") + data)

    def raw_ids(self, data: bytes) -> tuple[bytes, bytes]:
        """Content and storage identity of raw bytes."""
        return self.hash(self.domain("raw-content") + data), self.hash(self.domain("raw-storage") + data)


class Bounds(NamedTuple):
    """The default resource bounds."""

    catalog: int = 16 << 20
    entries: int = 1_000_000
    frame: int = 64 << 20
    generations: int = 4096


class ContainerError(ValueError):
    """A file that breaks the layout, a digest or a bound."""


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * width:
            return bytes([major << 5 | code]) + n.to_bytes(width, "big")
    raise ContainerError("length out of range")


def _byte_string(b: bytes) -> bytes:
    return _head(2, len(b)) + b


def encode_catalog(document: bytes, root_id: bytes, references: Iterable[bytes]) -> bytes:
    refs = sorted(set(references))
    return b"\xa3\x01" + _byte_string(document) + b"\x02" + _byte_string(root_id) + b"\x03" + _head(4, len(refs)) + b"".join(map(_byte_string, refs))


def decode_catalog(data: bytes) -> tuple[bytes, bytes, list[bytes]]:
    """Document, root and references; a catalog that is not in the one canonical form is an error."""
    at = 0

    def head(major: int) -> int:
        nonlocal at
        first = data[at] if at < len(data) else 0xFF
        at += 1
        if first >> 5 != major or first & 31 > 27:
            raise ContainerError("catalog type")
        n = first & 31
        if n >= 24:
            width = 1 << n - 24
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        return n

    def string() -> bytes:
        nonlocal at
        n = head(2)
        at += n
        return data[at - n : at]

    def key(expected: int) -> None:
        if head(0) != expected:
            raise ContainerError("catalog key")

    if head(5) != 3:
        raise ContainerError("catalog size")
    key(1)
    document = string()
    key(2)
    root = string()
    key(3)
    count = head(4)
    if count > len(data):
        raise ContainerError("catalog references")
    refs = [string() for _ in range(count)]
    if encode_catalog(document, root, refs) != data or len(root) != 32 or any(len(r) != 32 for r in refs):
        raise ContainerError("catalog is not canonical")
    return document, root, refs


def _index(fmt: Format, catalog: bytes, frames: list[tuple[bytes, bytes, int, int, bytes]], start: int) -> bytes:
    out = [fmt.index_magic, struct.pack("<II", len(frames), 0), fmt.hash(catalog)]
    for content_id, storage_id, kind, element, data in frames:
        out.append(content_id + storage_id + struct.pack("<QQBB14x", start, len(data), kind, element) + fmt.hash(data))
        start += len(data)
    return b"".join(out)


Frame = tuple[bytes, bytes, int, int, bytes]


def raw_frame(fmt: Format, data: bytes) -> Frame:
    return (*fmt.raw_ids(data), RAW, 0, data)


def semantic_frame(fmt: Format, element: str, data: bytes) -> Frame:
    """Payload bytes under their semantic identity."""
    return fmt.hash(fmt.names.payload(element) + data), fmt.hash(fmt.domain("raw-storage") + data), SEMANTIC, ELEMENTS.index(element) + 1, data


def embedded_frame(fmt: Format, data: bytes, bounds: Bounds = Bounds()) -> Frame:
    """A whole sealed file as a frame of another."""
    inner = parse(fmt, data, bounds)
    if any(f["kind"] == EMBEDDED for f in inner["frames"]):
        raise ContainerError("embedded files cannot embed others")
    return inner["root_id"], inner["storage_id"], EMBEDDED, 0, data


def encode(fmt: Format, document: bytes, root_id: bytes, references: Iterable[bytes] = (), payloads: Iterable[bytes] = (), profile: int = profiles.LOSSLESS,
           root_kind: int = 1, bounds: Bounds = Bounds(), frames: Iterable[Frame] = ()) -> bytes:
    """A sealed file of raw payloads and other frames, equal ones once, in the order of their content ids."""
    if not profiles.accepts(profile, root_kind):
        raise ContainerError("the profile does not accept the root")
    catalog = encode_catalog(document, root_id, references)
    held: dict[bytes, Frame] = {}
    for f in (*(raw_frame(fmt, p) for p in payloads), *frames):
        if held.setdefault(f[0], f)[2:] != f[2:]:
            raise ContainerError("two frames of one identity")
    ordered = sorted(held.values())
    if len(catalog) > bounds.catalog or len(ordered) > bounds.entries or any(len(f[4]) > bounds.frame for f in ordered):
        raise ContainerError("content passes a bound")
    body = b"".join(f[4] for f in ordered)
    index = _index(fmt, catalog, ordered, ENVELOPE + len(catalog))
    at = ENVELOPE + len(catalog) + len(body)
    head = ENVELOPE_FIELDS.pack(fmt.magic, MAJOR, MINOR, ENVELOPE, profile, SEMANTIC_GENERATION, 0, 0, root_kind, SEALED, PLAINTEXT, BLAKE3_256,
                                bounds.catalog, bounds.entries, bounds.frame, ENVELOPE, len(catalog), at, len(index), 0, root_id)
    return head + catalog + body + index


def pack(fmt: Format, root: bytes, objects: dict[bytes, bytes], bounds: Bounds = Bounds()) -> bytes:
    """A portable file: the root with every file it reaches embedded. objects are sealed files by root id; only those that are reached may be given."""
    outer = parse(fmt, root, bounds)
    if outer["profile"] not in profiles.PROFILES or not profiles.PROFILES[outer["profile"]].portable:
        raise ContainerError("the profile is not portable")
    frames = {key: embedded_frame(fmt, data, bounds) for key, data in objects.items()}
    _closed(outer["root_id"], outer["references"], {key: parse(fmt, data, bounds)["references"] for key, data in objects.items()})
    own = [(f["content_id"], f["storage_id"], f["kind"], f["element"], f["data"]) for f in outer["frames"]]
    return encode(fmt, outer["document"].encode(), outer["root_id"], outer["references"], (), outer["profile"], outer["root_kind"], bounds, [*own, *frames.values()])


def _closed(root: bytes, references: list[bytes], held: dict[bytes, list[bytes]]) -> None:
    """Whether what the root reaches is exactly what is held."""
    reached, open_ = set(), list(references)
    while open_:
        key = open_.pop()
        if key in reached or key == root:
            continue
        if key not in held:
            raise ContainerError(f"incomplete closure: {key.hex()}")
        reached.add(key)
        open_ += held[key]
    if extra := set(held) - reached:
        raise ContainerError(f"extra frame: {min(extra).hex()}")


def unpack(fmt: Format, data: bytes, bounds: Bounds = Bounds()) -> list[tuple[bytes, bytes]]:
    """The files of a portable one as (root id, bytes), embedded ones first and the root without them last; nothing unless all of it verifies."""
    outer = parse(fmt, data, bounds)
    inner = [f for f in outer["frames"] if f["kind"] == EMBEDDED]
    _closed(outer["root_id"], outer["references"], {f["content_id"]: parse(fmt, f["data"], bounds)["references"] for f in inner})
    own = [(f["content_id"], f["storage_id"], f["kind"], f["element"], f["data"]) for f in outer["frames"] if f["kind"] != EMBEDDED]
    root = encode(fmt, outer["document"].encode(), outer["root_id"], outer["references"], (), outer["profile"], outer["root_kind"], bounds, own)
    return [*((f["content_id"], f["data"]) for f in inner), (outer["root_id"], root)]


def _footer(fmt: Format, number: int, previous: tuple[int, bytes], catalog: tuple[int, bytes], index: tuple[int, bytes], root_id: bytes) -> bytes:
    first = FOOTER_FIELDS.pack(fmt.footer_magic, 2, 0, FOOTER, number, *previous, catalog[0], len(catalog[1]), index[0], len(index[1]), root_id, b"")[:128]
    return first + blake3(fmt.domain("generation-v1") + first + catalog[1] + index[1])


def start_generations(fmt: Format, sealed: bytes) -> bytes:
    """The sealed file as generation 0 of an appendable one."""
    f = ENVELOPE_FIELDS.unpack(sealed[:ENVELOPE])
    catalog, index = (f[15], sealed[f[15] : f[15] + f[16]]), (f[17], sealed[f[17] : f[17] + f[18]])
    out = bytearray(sealed + _footer(fmt, 0, (0, bytes(32)), catalog, index, f[20]))
    out[41] = GENERATIONAL
    struct.pack_into("<Q", out, 88, len(sealed))
    return bytes(out)


def append_generation(fmt: Format, data: bytes, document: bytes, root_id: bytes, references: Iterable[bytes] = ()) -> bytes:
    """One generation more; of the earlier bytes only the pointer to the footer and the root change."""
    chain = generations(fmt, data)
    catalog = encode_catalog(document, root_id, references)
    index = _index(fmt, catalog, [], 0)
    at = len(data)
    footer = _footer(fmt, chain[0]["generation"] + 1, (chain[0]["offset"], chain[0]["digest"]), (at, catalog), (at + len(catalog), index), root_id)
    out = bytearray(data + catalog + index + footer)
    struct.pack_into("<Q32s", out, 88, at + len(catalog) + len(index), root_id)
    return bytes(out)


def generations(fmt: Format, data: bytes, most: int = Bounds().generations) -> list[dict]:
    """The chain of footers, newest first, each link and digest checked."""
    at, out, wanted = struct.unpack_from("<Q", data, 88)[0], [], None
    if at + FOOTER != len(data):
        raise ContainerError("the file does not end with its latest footer")
    while True:
        if len(out) == most:
            raise ContainerError("too many generations")
        if at < ENVELOPE or at + FOOTER > len(data):
            raise ContainerError("footer out of the file")
        magic, major, minor, size, number, back, back_digest, c_at, c_n, i_at, i_n, root, digest = FOOTER_FIELDS.unpack_from(data, at)
        if (magic, major, minor, size) != (fmt.footer_magic, 2, 0, FOOTER):
            raise ContainerError("footer head")
        if c_at + c_n > i_at or i_at + i_n > at:
            raise ContainerError("footer extents")
        if digest != blake3(fmt.domain("generation-v1") + data[at : at + 128] + data[c_at : c_at + c_n] + data[i_at : i_at + i_n]):
            raise ContainerError("footer digest")
        if wanted is not None and (number, digest) != wanted:
            raise ContainerError("broken chain")
        out.append({"generation": number, "offset": at, "digest": digest, "root_id": root, "catalog": (c_at, c_n), "index": (i_at, i_n)})
        if number == 0:
            if back or any(back_digest):
                raise ContainerError("generation 0 has a predecessor")
            return out
        if back >= at:
            raise ContainerError("chain does not go back")
        at, wanted = back, (number - 1, back_digest)


def parse(fmt: Format, data: bytes, bounds: Bounds = Bounds()) -> dict:
    """One file's envelope, catalog and frames with every digest checked. A generational file is read at its latest generation."""
    if len(data) < ENVELOPE:
        raise ContainerError("shorter than an envelope")
    (magic, major, minor, size, profile, semantic, required, _, kind, contract, privacy, integrity, c_most, n_most, f_most,
     c_at, c_n, i_at, i_n, latest, root) = ENVELOPE_FIELDS.unpack(data[:ENVELOPE])
    if magic != fmt.magic or (major, minor) != (MAJOR, MINOR) or size != ENVELOPE or semantic != SEMANTIC_GENERATION or integrity != BLAKE3_256:
        raise ContainerError("envelope head")
    if required or privacy != PLAINTEXT or contract not in (SEALED, GENERATIONAL):
        raise ContainerError("unsupported envelope")
    if not profiles.accepts(profile, kind):
        raise ContainerError("unknown profile, or one that does not accept the root")
    if not (0 < c_most <= bounds.catalog and 0 < n_most <= bounds.entries and 0 < f_most <= bounds.frame):
        raise ContainerError("declared bounds")
    if (contract == GENERATIONAL) != (latest != 0):
        raise ContainerError("contract and footer disagree")
    end, number = len(data), 0
    if latest:
        chain = generations(fmt, data, bounds.generations)
        newest = chain[0]
        if chain[-1]["catalog"] != (c_at, c_n) or chain[-1]["index"] != (i_at, i_n):
            raise ContainerError("envelope and oldest generation disagree")
        (c_at, c_n), (i_at, i_n), end, number = newest["catalog"], newest["index"], newest["offset"], newest["generation"]
        if newest["root_id"] != root:
            raise ContainerError("torn publication pointer")
    elif c_at != ENVELOPE:
        raise ContainerError("catalog offset")
    if c_n > min(c_most, bounds.catalog) or c_at + c_n > i_at or i_at + i_n != end:
        raise ContainerError("extents")
    catalog, index = data[c_at : c_at + c_n], data[i_at : i_at + i_n]
    document, catalog_root, references = decode_catalog(catalog)
    if catalog_root != root:
        raise ContainerError("root of the catalog")
    if len(index) < INDEX_HEAD or index[:8] != fmt.index_magic or index[12:16] != bytes(4) or index[16:48] != fmt.hash(catalog):
        raise ContainerError("index head")
    count = int.from_bytes(index[8:12], "little")
    if count > min(n_most, bounds.entries) or len(index) != INDEX_HEAD + count * INDEX_ENTRY:
        raise ContainerError("index size")
    frames, at, before = [], c_at + c_n, b""
    for i in range(count):
        entry = index[INDEX_HEAD + i * INDEX_ENTRY :][:INDEX_ENTRY]
        offset, length, frame_kind, element = struct.unpack_from("<QQBB", entry, 64)
        body = data[offset : offset + length]
        if offset != at or length > min(f_most, bounds.frame) or offset + length > i_at or entry[82:96] != bytes(14):
            raise ContainerError("frame extent")
        if entry[:32] <= before or entry[96:] != fmt.hash(body):
            raise ContainerError("frame order or digest")
        if frame_kind not in (EMBEDDED, RAW, SEMANTIC) or (frame_kind == SEMANTIC) != (1 <= element <= 15) or frame_kind != SEMANTIC and element:
            raise ContainerError("frame kind")
        if frame_kind == RAW and raw_frame(fmt, body)[:2] != (entry[:32], entry[32:64]):
            raise ContainerError("frame identity")
        if frame_kind == SEMANTIC and semantic_frame(fmt, ELEMENTS[element - 1], body)[:2] != (entry[:32], entry[32:64]):
            raise ContainerError("frame identity")
        if frame_kind == EMBEDDED and embedded_frame(fmt, body, bounds)[:2] != (entry[:32], entry[32:64]):
            raise ContainerError("embedded root")
        frames.append({"content_id": entry[:32], "storage_id": entry[32:64], "kind": frame_kind, "element": element, "offset": offset, "length": length, "data": body})
        before, at = entry[:32], offset + length
    if at != i_at:
        raise ContainerError("bytes between frames and index")
    return {"storage_id": fmt.storage_id(data), "contract": contract, "profile": profile, "root_kind": kind, "generation": number, "root_id": root,
            "document": document.decode(), "references": references, "frames": frames}


def messages_of(fmt: Format, data: bytes) -> list[bytes]:
    """What parse() hashes of a sealed file, as far as its envelope can be believed; wrong guesses only cost time."""
    out = [fmt.domain("storage") + data]
    if len(data) >= ENVELOPE:
        c_at, c_n, i_at, i_n = struct.unpack_from("<QQQQ", data, 56)
        out.append(data[c_at : c_at + c_n])
        index = data[i_at : i_at + i_n]
        for at in range(INDEX_HEAD, len(index) - INDEX_ENTRY + 1, INDEX_ENTRY):
            offset, length, kind, _ = struct.unpack_from("<QQBB", index, at + 64)
            if kind == RAW and length <= len(data):
                out += fmt.frame_messages(data[offset : offset + length])
    return out


FRAMES = "array<struct<content_id: binary, storage_id: binary, kind: int, element: int, offset: long, length: long, data: binary>>"
READ = f"path string, storage_id binary, profile long, root_kind int, generation long, root_id binary, document string, references array<binary>, frames {FRAMES}, error string"


def read_containers(spark: SparkSession, path: str, fmt: Format, payloads: bool = False, bounds: Bounds = Bounds()) -> DataFrame:
    """One row a file under path; a file that does not verify has its error and nulls. Frames carry their bytes only with payloads."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ready = fmt.knowing(m for content in batch["content"] for m in messages_of(fmt, bytes(content)))
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = parse(ready, bytes(content), bounds) | {"error": None}
                    del found["contract"]
                    if not payloads:
                        found["frames"] = [f | {"data": None} for f in found["frames"]]
                except (ContainerError, UnicodeDecodeError, struct.error) as error:
                    found = dict.fromkeys(("storage_id", "profile", "root_kind", "generation", "root_id", "document", "references", "frames")) | {"error": str(error)}
                yield pd.DataFrame([{"path": name, **found}], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(rows, READ)


def frame_rows(containers: DataFrame) -> DataFrame:
    return containers.where("error is null").select("path", "root_id", F.posexplode("frames").alias("ordinal", "f")).select("path", "root_id", "ordinal", "f.*")


def encode_containers(datasets: DataFrame, fmt: Format, profile: int = profiles.LOSSLESS) -> DataFrame:
    """root_id and artifact of each row of datasets (root_id binary, document string, references and payloads array<binary>, null as empty)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            listed = [(bytes(root), document.encode(), [bytes(r) for r in ([] if refs is None else refs)], [bytes(p) for p in ([] if payloads is None else payloads)]) for root, document, refs, payloads in batch.itertuples(index=False)]
            ready = fmt.knowing(m for root, document, refs, payloads in listed for m in (encode_catalog(document, root, refs), *(x for p in payloads for x in fmt.frame_messages(p))))
            yield pd.DataFrame([(root, encode(ready, document, root, refs, payloads, profile)) for root, document, refs, payloads in listed], columns=["root_id", "artifact"])

    return datasets.select("root_id", "document", "references", "payloads").mapInPandas(rows, "root_id binary, artifact binary")
