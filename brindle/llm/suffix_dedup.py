"""Exact removal of repeated 100-byte strings by merged Burrows-Wheeler transforms.

A global suffix order would be one task's work, so windows of `length` bytes are first dealt out so
that equal windows always meet. The anchor of a window is the least-hashed `GRAM`-byte string in it
(the leftmost of equals); equal windows have equal anchors. Consecutive windows with the same anchor
position form one short string (at most 2 * length - GRAM bytes). Equal strings are collapsed
to their earliest occurrence, inside each map task before the exchange and then by anchor; the later
ones are repeats as a whole. Strings that share an anchor but differ are what is left to compare: for
these, shards of strings get Burrows-Wheeler transforms, and the transforms of a piece of work are merged by
iterative interleave refinement: each round extends the common prefix by one symbol with the LF
mapping, splits the intervals of the interleave, sets the common-prefix length where an interval
splits, and drops settled intervals. No suffix is sorted again. Intervals that stay together for
`length` rounds are the repeated strings; all but the earliest start are repeats.

Anchors that a sample of the documents shows in many contexts (a common passage) are hot: their strings
are cut into single windows, each dealt by its own hash, so a passage in a third of all documents is
spread over all tasks. The sample only chooses this form; results do not depend on it.

Documents are ordered by id, nulls first. Rows of equal id are told apart, and ordered, by the hash of
their text; wholly equal rows are one document and get one result. Null texts are empty. Texts below
`length` bytes lose nothing. An empty table gives an empty result. Extra columns are carried; columns named
like the results are replaced.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ROW, U64, as_long, checkpointed, column, kept_columns, mapped, mix64, named, packed, parts_for, record, reuse_memory, sorted_runs, text_slices, unpacked, with_fields

LENGTH = 100
GRAM = 32
BLOCK = 1 << 19  # windows handled at once; positions in a block fit POSITION_BITS
POSITION_BITS = 20
HOT_SAMPLE = 32  # one document of so many is looked at for hot anchors
HOT_CONTEXTS = 24
HOT_MOST = 1 << 16
ROWS_A_FLUSH = 600_000
MERGE_BYTES = 1 << 17
SHARD_BYTES = 1 << 15

_VALUE = np.random.RandomState(104729).randint(1, 2**63 - 1, 256).astype(U64)
_STEP = np.random.RandomState(1299709).randint(1, 2**63 - 1, 8).astype(U64) * U64(2) + U64(1)
#: In packed, from the top: start; how far in the anchor begins (7 bits); SIDE_BITS of the hash of the 64 bytes that begin
#: with the anchor, and as many of that of the 64 bytes that end with it; windows (7 bits). Two strings of one anchor
#: can share a window only if they agree on a side, since a window has at least (length - GRAM) / 2 bytes more on one
#: side of its anchor than the anchor.
SIDE_BITS = 9
SIDE = (1 << SIDE_BITS) - 1
RIGHT, LEFT, INTO, START = 7, 7 + SIDE_BITS, 7 + 2 * SIDE_BITS, 14 + 2 * SIDE_BITS


def _pack(start: np.ndarray, into: np.ndarray, sides: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (start << START) | (into << INTO) | (sides << RIGHT) | n


def _start_and_windows(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> START, packed & 127


def _gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of GRAM bytes and of 64 bytes."""
    h = _VALUE[data]
    size, i, short = 1, 0, None
    while size < 64:
        h = h[:-size] * _STEP[i] + h[size:]
        h ^= h >> U64(29)
        size, i = size * 2, i + 1
        if size == GRAM:
            short = h
    return mix64(short), h


def anchored(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Row, start in the slice, packed form, anchor and content hash of the strings of all rows of a slice."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    low = U64((1 << POSITION_BITS) - 1)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        for at in range(0, max(0, len(data) - length + 1), BLOCK):
            part = data[at : at + BLOCK + length - 1]
            gram, long = _gram_hashes(part)
            m = (gram & ~low) | np.arange(len(gram), dtype=U64)
            width, size = length - GRAM + 1, 1
            while size * 2 <= width:
                m = np.minimum(m[:-size], m[size:])
                size *= 2
            m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
            pos = (m & low).astype(np.int64)
            starts = at + np.arange(len(pos))
            row = rows[at : at + len(pos)]
            valid = starts + length <= offsets[row + 1]
            new = np.ones(len(pos), bool)
            new[1:] = (pos[1:] != pos[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
            first = np.flatnonzero(new & valid)
            if not len(first):
                continue
            end = np.cumsum(valid)
            stop = np.append(first[1:], len(pos))
            n = end[stop - 1] - end[first] + 1
            text = n + length - 1
            a, b, c = long[first], long[first + (text - 64) // 2], long[first + text - 64]
            content = mix64(a + mix64(b + U64(0x9E3779B97F4A7C15)) * U64(3) + mix64(c + n.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
            p = pos[first]
            right = long[np.minimum(p, len(long) - 1)] >> U64(64 - SIDE_BITS)
            left = long[np.maximum(p - (64 - GRAM), 0)] >> U64(64 - SIDE_BITS)
            sides = ((left << U64(SIDE_BITS)) | right).astype(np.int64)
            form = _pack(starts[first] - offsets[row[first]], p - first, sides, n)
            for o, x in zip(out, (row[first], starts[first], form, gram[p], content), strict=True):
                o.append(x)
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U64), z.view(U64)
    return tuple(np.concatenate(o) for o in out)


def _single_windows(data: np.ndarray, strings: tuple[np.ndarray, ...], length: int) -> tuple[np.ndarray, ...]:
    """The strings' windows, each with two hashes of its own as anchor and content."""
    row, start, packed = strings[:3]
    n = packed & 127
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    each = np.repeat(start, n) + inside
    grams = np.lib.stride_tricks.sliding_window_view(data, length)
    one, two = np.zeros(len(each), U64), np.zeros(len(each), U64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(each), 4096):
            v = _VALUE[grams[each[lo : lo + 4096]]]
            for j in range(length):
                one[lo : lo + 4096] = mix64(one[lo : lo + 4096] + v[:, j])
                two[lo : lo + 4096] = (two[lo : lo + 4096] + v[:, j]) * _STEP[7]
    form = _pack(np.repeat(packed >> START, n) + inside, inside * 0, inside * 0, inside * 0 + 1)
    return np.repeat(row, n), each, form, one, mix64(two)


def _firsts(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, content, document and start, and whether each in it is the first of its string."""
    order = np.lexsort((packed, doc, content, anchor))
    new = np.ones(len(order), bool)
    new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
    return order, new


def _joined_runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that follow each other made one."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + n)[order]
    big = int(stop.max()) + 1
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * big
    reach = np.maximum.accumulate(base + stop)
    new = np.ones(len(doc), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (reach - base)[last] - start[first]


_STRINGS = pa.schema([("route", pa.int64()), ("content", pa.int64()), ("doc", pa.int64()), ("packed", pa.int64()), ("windows", pa.int64())])


def _strings(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """Rows by anchor; windows is 0 for a string (packed has its start and windows), else a repeat found in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        kept: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, packed, anchor, content = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            order, new = _firsts(anchor, content, doc, packed)
            first, later = order[new], order[~new]
            yield record(_STRINGS, as_long(anchor[first]), as_long(content[first]), doc[first], packed[first], np.zeros(len(first), np.int64))
            d, s, n = _joined_runs(doc[later], *_start_and_windows(packed[later]))
            yield record(_STRINGS, as_long(mix64(d.astype(U64))), np.zeros(len(d), np.int64), d, s, n)

        for batch in batches:
            docs_of = np.asarray(column(batch, "doc"))
            for lo, _, data, offsets in text_slices(column(batch, "text"), BLOCK):
                found = anchored(data, offsets, length)
                is_hot = np.isin(found[3], hot) if len(hot) else np.zeros(len(found[3]), bool)
                parts = [tuple(x[~is_hot] for x in found)] if is_hot.any() else [found]
                if is_hot.any():
                    parts.append(_single_windows(data, tuple(x[is_hot] for x in found), length))
                for row, _, packed, anchor, content in parts:
                    kept.append((docs_of[lo + row], packed, anchor, content))
                if sum(len(x[0]) for x in kept) >= ROWS_A_FLUSH:
                    yield from flush()
        if kept:
            yield from flush()

    return docs.select("doc", "text").transform(mapped(run, "route long, content long, doc long, packed long, windows long"))


def hot_anchors(docs: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Anchors that a sample of the documents has in many contexts; at most HOT_MOST."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(column(batch, "text"), BLOCK):
                _, _, _, anchor, content = anchored(data, offsets, length)
                pair = np.unique(np.stack([as_long(anchor), as_long(content)]), axis=1)
                yield record(schema, pair[0], pair[1])

    drawn = docs.where(F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(HOT_SAMPLE)) == 0).select("doc", "text").transform(mapped(run, "anchor long, content long"))
    many = drawn.distinct().groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_CONTEXTS)
    return np.array(sorted(r["anchor"] for r in many.orderBy(F.desc("n"), "anchor").limit(HOT_MOST).collect()), np.int64).view(U64)


_MARKS = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _marks(strings: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeats found by equal strings (anchor null), and strings still to compare (with their anchor).

    A partition is sorted by Spark, which spills, and read as a stream of whole anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "route"):
            route, content, doc, packed_form, windows = (table.column(c).to_numpy() for c in _STRINGS.names)
            done = windows > 0
            if done.any():
                yield record(_MARKS, pa.nulls(int(done.sum()), pa.int64()), doc[done], packed_form[done], windows[done])
            anchor, content, doc, packed_form = (x[~done] for x in (route, content, doc, packed_form))
            order, new = _firsts(anchor, content, doc, packed_form)
            d, s, n = _joined_runs(doc[order[~new]], *_start_and_windows(packed_form[order[~new]]))
            yield record(_MARKS, pa.nulls(len(d), pa.int64()), d, s, n)
            first = order[new]
            which, start, windows = shared_part(anchor[first], packed_form[first], length)
            left = first[which]
            yield record(_MARKS, anchor[left], doc[left], start, windows)

    return strings.repartition(parts, "route").sortWithinPartitions("route").transform(mapped(run, "anchor long, doc long, start long, windows long"))


def shared_part(anchor: np.ndarray, packed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings that may share a window with another of their anchor, and the start and windows of the part that may.

    anchor is sorted. If only the right sides agree, such a window has less than 64 - GRAM bytes left of
    the anchor or enough on its right; if only the left ones, the other way round.
    """
    group = np.cumsum(np.append(False, anchor[1:] != anchor[:-1])[: len(anchor)])
    agree = []
    for shift in (LEFT, RIGHT):
        key = (group << SIDE_BITS) | ((packed >> shift) & SIDE)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out = np.zeros(len(anchor), bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        agree.append(out)
    left, right = agree
    start, n = _start_and_windows(packed)
    into = (packed >> INTO) & 127
    side = 64 - GRAM
    lo = np.where(left, 0, np.maximum(0, into + GRAM + side - length))  # from here on a window holds the right side
    hi = np.where(right, n, np.minimum(n, into - side + 1))  # up to here it holds the left one
    which = np.flatnonzero((left | right) & (hi > lo))
    return which, (start + lo)[which], (hi - lo)[which]


def suffix_order(text: np.ndarray, ends: int) -> np.ndarray:
    """Suffix array of one shard by prefix doubling; text has `ends` zeros, each its own least symbol in turn."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    new = np.ones(n, bool)
    new[ends:] = np.append(True, sorted_text[ends + 1 :] != sorted_text[ends:-1]) if n > ends else new[ends:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while True:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        items = order[at]
        key = rank[items] * n + rank[np.minimum(items + k, n - 1)]
        by = np.argsort(key, kind="stable")
        items, key = items[by], key[by]
        order[at] = items
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        rank[items] = np.maximum.accumulate(np.where(fresh, at, 0))
        k *= 2


def merge_transforms(shards: list[tuple[np.ndarray, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated intervals of the merged order of shards (text, strings in it).

    Returns the merged rows that lie in intervals whose common prefix is at least `length`, as positions
    in the shards' joined texts; the interval of each; and a histogram of the common-prefix lengths
    found below `length`.
    """
    transform, following, position = [], [], []
    rows = texts = 0
    for text, ends in shards:
        order = suffix_order(text, ends)
        symbols = np.where(order > 0, text[order - 1], 0).astype(text.dtype)
        back = np.empty(len(text), np.int32)
        back[np.argsort(symbols, kind="stable")] = np.arange(len(text), dtype=np.int32)
        transform.append(symbols)
        following.append(back + np.int32(rows))
        position.append(order + texts)
        rows, texts = rows + len(text), texts + len(text)
    symbol, lf, position = np.concatenate(transform), np.concatenate(following), np.concatenate(position)
    interleave, interval = np.arange(rows, dtype=np.int32), np.zeros(rows, np.int32)
    prefixes = np.zeros(length, np.int64)
    for depth in range(1, length + 1):
        s = symbol[interleave]
        by = np.argsort(s, kind="stable")
        s, before, interleave = s[by], interval[by], lf[interleave[by]]
        splits = np.ones(len(s) + 1, bool)
        splits[1:-1] = (s[1:] != s[:-1]) | (before[1:] != before[:-1]) | (s[1:] == 0)
        prefixes[depth - 1] += int(splits.sum()) - 1
        interval = np.cumsum(splits[:-1], dtype=np.int32)
        stay = ~(splits[:-1] & splits[1:])
        if not stay.all():
            interleave, interval = interleave[stay], interval[stay]
        if not len(interleave):
            break
    return position[interleave], interval, prefixes


def repeated_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, start, windows) of the windows of the strings that also start earlier in one of them."""
    shards, size, at = [], 0, []
    current: list[bytes] = []
    offsets = []
    total = 0
    for text in strings:
        offsets.append(total)
        total += len(text) + 1
        current.append(text)
        size += len(text) + 1
        if size >= SHARD_BYTES:
            shards.append(current)
            current, size = [], 0
    if current:
        shards.append(current)
    built = []
    for group in shards:
        lengths = np.fromiter((len(x) for x in group), np.int64, len(group)) + 1
        raw = np.frombuffer(b"\0".join(group) + b"\0", np.uint8)
        raw = raw + np.uint8(1) if raw.max() < 255 else raw.astype(np.uint16) + np.uint16(1)
        raw[np.cumsum(lengths) - 1] = 0  # the ends
        built.append((raw, len(group)))
    at, interval, _ = merge_transforms(built, length)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z
    which = np.searchsorted(np.array(offsets), at, side="right") - 1
    d, p = doc[which], start[which] + at - np.array(offsets)[which]
    order = np.lexsort((p, d, interval))
    first = np.ones(len(order), bool)
    first[1:] = interval[order][1:] != interval[order][:-1]
    later = order[~first]
    return _joined_runs(d[later], p[later], np.ones(len(later), np.int64))


def _compared(candidates: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeats among strings (anchor, doc, start, string) that share an anchor."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, "anchor"):
            anchor, doc, start = (table.column(c).to_numpy() for c in ("anchor", "doc", "start"))
            sizes = np.asarray(pa.compute.binary_length(table.column("string"))).astype(np.int64)
            order = np.lexsort((start, doc, anchor))
            group_end = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
            filled = np.cumsum(sizes[order])
            lo = 0
            while lo < len(order):
                goal = (filled[lo - 1] if lo else 0) + MERGE_BYTES
                hi = int(group_end[min(np.searchsorted(group_end, max(lo + 1, np.searchsorted(filled, goal))), len(group_end) - 1)])
                some = order[lo:hi]
                texts = table.column("string").take(pa.array(some)).to_pylist()
                yield record(schema, *repeated_windows(texts, doc[some], start[some], length))
                lo = hi

    return candidates.repartition(parts, "anchor").sortWithinPartitions("anchor").transform(mapped(run, "doc long, start long, windows long"))


def _cut_strings(candidates: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The candidates (anchor, doc, start, windows) with their bytes."""
    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("string", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = column(batch, "found")
            docs_of = column(batch, "doc").to_numpy()
            for lo, hi, data, offsets in text_slices(column(batch, "text")):
                part = found.slice(lo, hi - lo)
                n = np.asarray(pa.compute.list_value_length(part)).astype(np.int64)
                flat = part.flatten()
                anchor, start, windows = (np.asarray(flat.field(i)) for i in range(3))
                at = start + np.repeat(offsets[:-1], n)
                raw = data.tobytes()
                yield record(schema, anchor, np.repeat(docs_of[lo:hi], n), start, [raw[a : a + w + length - 1] for a, w in zip(at.tolist(), windows.tolist(), strict=True)])

    per_doc = candidates.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("found"))
    return docs.join(per_doc, "doc").select("doc", "text", "found").transform(mapped(run, "anchor long, doc long, start long, string binary"))


def ordered_documents(df: DataFrame, carry: list[str], text: str, row_id: str) -> tuple[DataFrame, bool]:
    """The packed row, _text and doc, a number for each (id, text) that keeps the order of ids: the id itself where that is a key; and whether it is."""
    slim = df.select(packed(carry), named(text).alias("_text"), named(row_id).cast("long").alias("_id"))
    twice = slim.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or _id is null")
    if dict(df.dtypes)[row_id] in ("bigint", "int", "smallint", "tinyint") and twice.isEmpty():
        return slim.withColumnRenamed("_id", "doc"), True
    keyed = df.select(packed(carry), named(text).alias("_text"), named(row_id).alias("_id")).withColumn("_hash", F.xxhash64("_text"))
    pairs = keyed.select("_id", F.col("_hash").alias("_h")).distinct().withColumnRenamed("_id", "_i")
    pairs = pairs.repartitionByRange(parts_for(df), F.col("_i").asc_nulls_first(), "_h").sortWithinPartitions(F.col("_i").asc_nulls_first(), "_h")
    numbered = checkpointed(pairs.withColumn("doc", F.monotonically_increasing_id()))
    return keyed.join(numbered, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select(ROW, "_text", "doc"), False


def remove_repeats(df: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = LENGTH, carry: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """df's columns (or those in `carry`) with n_bytes, n_removed, n_spans, kept_sha256, spans and, if asked, kept_text.

    spans lists the removed byte ranges. kept_text drops the bytes of characters that a cut left incomplete;
    kept_sha256 is of the exact remaining bytes.
    """
    made = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"}
    carry = kept_columns(df, carry, made)
    keyed, is_key = ordered_documents(df, carry, text, row_id)
    docs = keyed.select("doc", F.col("_text").alias("text"))
    if not is_key:  # wholly equal rows are one document; met twice, all its strings would be repeats
        docs = docs.dropDuplicates(["doc"])
    parts = parts_for(df)
    marks = checkpointed(_marks(_strings(docs, length, hot_anchors(docs, length)), length, parts))
    _drop_shuffles(df)
    compared = checkpointed(_compared(_cut_strings(marks.where("anchor is not null"), docs, length), length, parts))
    _drop_shuffles(df)
    spans = marks.where("anchor is null").select("doc", "start", "windows").unionAll(compared)
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("_found"))
    joined = keyed.join(per_doc, "doc", "left").select(ROW, "_text", "_found")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept_text"] if keep_text else [])]
    span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = column(batch, "_text"), column(batch, "_found")
            counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(found), 0)).astype(np.int64)
            flat = found.flatten()
            start, windows = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            at = np.cumsum(counts) - counts
            rows = []
            for i, value in enumerate(texts):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                a, w = start[at[i] : at[i] + counts[i]], windows[at[i] : at[i] + counts[i]]
                _, s, n = _joined_runs(np.zeros(len(a), np.int64), a, w + length - 1)
                kept, last = [], 0
                for x, y in zip(s.tolist(), (s + n).tolist(), strict=True):
                    kept.append(raw[last:x])
                    last = y
                kept.append(raw[last:])
                rest = b"".join(kept)
                rows.append((len(raw), len(raw) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), [{"from": x, "to": y} for x, y in zip(s.tolist(), (s + n).tolist(), strict=True)], rest.decode("utf-8", "ignore") if value.is_valid else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.string()]
            arrays = [pa.array(c, t) for c, t, _ in zip(columns, types, names, strict=False)]
            yield pa.RecordBatch.from_arrays([column(batch, ROW), *arrays], names=[ROW, *names])

    schema = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "spans array<struct<`from`:long,`to`:long>>", *(["kept_text string"] if keep_text else [])]
    return unpacked(joined.transform(mapped(run, with_fields(joined, [ROW], ", ".join(schema)))), carry, *names)


def _drop_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner remove the shuffle files of steps that a checkpoint has replaced."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
