"""Document fingerprints from content-defined chunks.

A 32-bit gear hash of the last 4 bytes is compared with a strict mask below the normal chunk size and with a
loose one above it (normalised chunking), between a least and a most chunk size, so boundaries depend
on nearby bytes alone and move with them. A fingerprint is the set of chunk digests with the bytes of the
chunk as weight; containment of one document in another is the share of its weight that the other has.
The hash of a whole slice is computed at once by doubling. Chunks are short (about 12 bytes), so that texts of a few words still have some.

The comparison with the next document needs order by id: rows go once to contiguous ranges of (id, text hash), the first row
of a range goes to the range before as well, and each range is read as a stream. Only range boundaries
reach the driver. An id that many rows share (null is one) is cut by text hash; only wholly equal rows of one id stay in one range.

Null texts are empty; an empty document has an empty fingerprint, which is contained in itself alone (1) and in no
other, nor any other in it (0). Null ids come first. Rows of equal id are ordered by the hash of their
text. A single row is its own next. An empty table gives an empty result. Extra columns are carried; columns named
like the results are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import ROW, column, kept_columns, mapped, named, packed, parts_for, reuse_memory, unpacked, with_fields

WINDOW = 4  # at most LEAST, so that no boundary depends on what lies before the text
LEAST, NORMAL, MOST = 4, 12, 48
STRICT, LOOSE = np.uint32(0xF << 10), np.uint32(0x3 << 12)  # bits that depend on all bytes of the window
DIGEST_BYTES = 5
RANGE_BYTES = 16 << 20
BATCH_CHARS = 1 << 18
#: Boundaries are one literal that rows are searched in; beyond this many ranges they grow instead (each is sorted externally and streamed).
MOST_RANGES = 1 << 16
LOWEST = -(1 << 63)

_GEAR = np.random.RandomState(15485863).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash of the 32 bytes up to each byte (fewer at the start)."""
    h = _GEAR[data]
    size = 1
    with np.errstate(over="ignore"):
        while size < WINDOW:
            shifted = h[:-size] << np.uint32(size) if len(h) > size else h[:0]
            h = h.copy()
            h[size:] += shifted
            size *= 2
    return h


def chunk_ends(places: list[int], strict: list[bool], n: int) -> list[int]:
    """Ends of the chunks of n bytes, from the places where the loose mask matches."""
    out, start, i, m = [], 0, 0, len(places)
    while n - start > LEAST:
        low, normal, most = start + LEAST, start + NORMAL, min(n, start + MOST)
        while i < m and places[i] < low:
            i += 1
        j = i
        while j < m and places[j] < most and not (strict[j] or places[j] >= normal):
            j += 1
        start = places[j] + 1 if j < m and places[j] < most else most
        out.append(start)
        i = j
    if start < n:
        out.append(n)
    return out


def chunk_sets(texts: list[bytes]) -> list[dict[bytes, int]]:
    """Digest and weight of the distinct chunks of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    h = gear_hashes(np.frombuffer(b"".join(texts), np.uint8))
    at = np.flatnonzero((h & LOOSE) == 0)
    strict = (h[at] & STRICT) == 0
    bounds = np.searchsorted(at, offsets)
    digest = hashlib.blake2b
    out = []
    for i, text in enumerate(texts):
        a, z = bounds[i], bounds[i + 1]
        chunks, start = {}, 0
        for end in chunk_ends((at[a:z] - offsets[i]).tolist(), strict[a:z].tolist(), len(text)):
            chunks[digest(text[start:end], digest_size=DIGEST_BYTES).digest()] = end - start
            start = end
        out.append(chunks)
    return out


def as_text(chunks: dict[bytes, int]) -> str:
    """Sorted `digest-bytes` words in hexadecimal digits."""
    return " ".join(f"{d.hex()}-{n:x}" for d, n in sorted(chunks.items()))


def containment(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """The share of a's weight that b has."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fingerprint, for use without neighbours."""
    carry = kept_columns(df, None, ["fingerprint"])
    source = df.select(packed(carry), named(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[str] = []
            for at in range(0, batch.num_rows, 256):
                prints += map(as_text, chunk_sets([(t or "").encode() for t in column(batch.slice(at, 256), "_text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([column(batch, ROW), pa.array(prints, pa.string())], names=[ROW, "fingerprint"])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], "fingerprint string"))), carry, "fingerprint")


def _cuts(keyed: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Ascending boundaries (_key, _hash) of about equal bytes: quantiles of ids, and even cuts of the text hash within ids of many bytes."""
    size = F.octet_length("_text") + 64
    total = keyed.agg(F.sum(size)).first()[0] or 0
    parts = min(MOST_RANGES, max(parts, -(-total // RANGE_BYTES)))
    if parts < 2 or not total:
        return []
    share = -(-total // parts)
    quantiles = keyed.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    heavy = keyed.groupBy("_key").agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("rows")).where((F.col("n") > 2 * share) & (F.col("rows") > 1)).collect()  # at most parts / 2
    cuts = {(k, LOWEST) for k in quantiles}
    for r in heavy:
        pieces = -(-r["n"] // share)
        cuts |= {(r["_key"], LOWEST + (1 << 64) * i // pieces) for i in range(pieces)}
    return sorted(cuts)


def _below(cuts: list[tuple[int, int]]) -> Column:
    """How many of the ascending boundaries are at most the row's (_key, _hash): a binary search in a literal."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("_key"), F.lit(h).cast("long").alias("_hash")) for k, h in cuts]) if len(cuts) < 256 else F.from_json(F.lit(json.dumps([{"_key": k, "_hash": h} for k, h in cuts])), "array<struct<_key:long,_hash:long>>")
    row = F.struct("_key", "_hash")
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (row >= F.get(table, mid))
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when((s["lo"] < s["hi"]) & ~up, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), state, step, lambda s: s["lo"])


def _ranged(df: DataFrame, carry: list[str], text: str, row_id: str) -> DataFrame:
    """The packed rows in ranges of (id, text hash): columns _text, _range, _tail (a copy of the next range's first row), _key and _hash."""
    keyed = df.select(packed(carry), F.coalesce(named(row_id).cast("long"), F.lit(LOWEST)).alias("_key"), F.coalesce(named(text), F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("_text"))
    cuts = _cuts(keyed, parts_for(df))
    indexed = keyed.withColumn("_range", _below(cuts))
    first = F.min(F.struct("_key", "_hash")).alias("first")
    firsts = sorted((r["_range"], (r["first"]["_key"], r["first"]["_hash"])) for r in indexed.groupBy("_range").agg(first).collect())
    before = [(at, firsts[i - 1][0]) for i, (_, at) in enumerate(firsts)]  # the range before each range's first row
    none = F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("tail")))
    copies = none
    if before:
        spot = _below([at for at, _ in before]) - 1
        known = F.from_json(F.lit(json.dumps([{"_key": k, "_hash": h, "_to": to} for (k, h), to in before])), "array<struct<_key:long,_hash:long,_to:int>>")
        found = F.get(known, spot)
        is_first = (spot >= 0) & (found["_key"] == F.col("_key")) & (found["_hash"] == F.col("_hash"))
        copies = F.when(is_first, F.concat(none, F.array(F.struct(found["_to"].alias("range"), F.lit(True).alias("tail"))))).otherwise(none)
    dealt = indexed.withColumn("_copy", F.explode(copies)).withColumn("_range", F.col("_copy.range")).withColumn("_tail", F.col("_copy.tail"))
    return dealt.repartitionById(len(cuts) + 1, F.col("_range")).sortWithinPartitions("_range", "_tail", "_key", "_hash")


def compare_edited(df: DataFrame, text: str = "text", row_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """df's columns (or those in `carry`) with n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    made = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    carry = kept_columns(df, carry, made)
    source = _ranged(df, carry, text, row_id).select(ROW, "_text", "_range", "_tail")

    def compared(rows: pa.RecordBatch, texts: list[str], following: str) -> pa.RecordBatch:
        after = [*texts[1:], following]
        changed = [edited(a, b) for a, b in zip(texts, after, strict=True)]
        raw = [t.encode() for t in changed]
        own = chunk_sets([t.encode() for t in [*texts, following]])
        new = chunk_sets(raw)
        n = len(texts)
        columns = [
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
            pa.array([as_text(x) for x in own[:n]]),
            pa.array([as_text(x) for x in new]),
            pa.array([containment(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own[:n], own[1:], strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays([column(rows, ROW), *columns], names=[ROW, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            texts, tails = column(rows, "_text").to_pylist(), column(rows, "_tail").to_pylist()
            at, end = 0, len(texts) - 1  # every range ends with a tail, so each row but the last has its next here
            while at < end:
                to, chars = at, 0
                while to < end and not tails[to] and chars < BATCH_CHARS:
                    chars += len(texts[to])
                    to += 1
                if to > at:
                    yield compared(rows.slice(at, to - at), texts[at:to], texts[to])
                at = max(to, at + 1)
            last = rows.slice(end, 1)

    made_types = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], made_types))), carry, *made)
