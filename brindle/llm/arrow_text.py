"""Shared helpers: Arrow text batches as flat byte arrays, hashing, checkpoints.

The numpy helpers work on slices of about one megabyte of text so that their temporaries stay in
cache and memory is bounded by the slice, or by the longest single document where that is longer.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Word characters are all bytes but space and 0x09-0x0D, so words are `[^\x20\x09-\x0D]+`.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BYTE_VALUE = np.random.RandomState(7919).randint(1, 2**63 - 1, 256).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, kept between calls while small."""
    global _powers
    if n <= len(_powers):
        return _powers[:n]
    with np.errstate(over="ignore"):
        grown = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 4096) - 1, _BASE)]), dtype=U64)
    if n <= 1 << 16:
        _powers = grown
    return grown[:n]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_slices(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about target bytes; null reads as empty."""
    if pa.types.is_string(texts.type):
        width = np.int32
    else:
        texts, width = texts.cast(pa.large_string()), np.int64
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of a slice, and the index of the first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte spans."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    chars = data[at + np.repeat(starts, lengths)]
    with np.errstate(over="ignore"):
        return mix64(np.add.reduceat(_BYTE_VALUE[chars] * powers(int(lengths.max()))[at], first) + lengths.astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice in order, and the index of the first word of each row."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def reuse_memory() -> None:
    """Let a worker's C allocator keep freed arrays of up to 32 MB, which saves a page fault per page on each new one."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)
        libc.mallopt(-1, 64 << 20)


def mapped(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> Callable[[DataFrame], DataFrame]:
    """A transform that is mapInArrow(run, schema) in bounded memory.

    Arrow batches hold at most BATCH_BYTES and a row, unless the session already sets a bound: rows of long texts otherwise fill large
    buffers outside the heap. When a task ends its worker, which outlives it, gives freed memory back to the system.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def apply(df: DataFrame) -> DataFrame:
        conf = df.sparkSession.conf
        conf.set(BATCH_SETTING, conf.get(BATCH_SETTING, str(BATCH_BYTES)))
        return df.mapInArrow(task, schema)

    return apply


def record(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that spark.checkpoint.dir names; a folder of our own only where it is unset and the master is local."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="brindle-checkpoint-"))
    return df.checkpoint()


ROW = "_row"


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kept_columns(df: DataFrame, carry: list[str] | None, made: Iterable[str]) -> list[str]:
    """The columns to carry: all of df's or those named, but none called like a result (in any case of letters)."""
    taken = {m.lower() for m in made}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]


def packed(carry: list[str]) -> Column:
    """The carried columns as one struct, so that no name of theirs meets one of an operator's own; true where there are none."""
    return (F.struct(*map(named, carry)) if carry else F.lit(True)).alias(ROW)


def unpacked(df: DataFrame, carry: list[str], *made: str | Column) -> DataFrame:
    """The carried columns, then the results."""
    return df.select(*([f"{ROW}.*"] if carry else []), *made)


def with_fields(df: DataFrame, columns: list[str], made: str) -> StructType:
    """The schema of some columns of df followed by the fields of a DDL string."""
    return StructType([df.schema[c] for c in columns] + StructType.fromDDL(made).fields)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of rows of equal key from batches sorted by it; several groups at once, no more held than the open group and a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or column(held[-1], key)[-1].as_py() != keys[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "left", stats: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """rows joined to a table of one row a key; a key of more than 1 / share of the rows is spread over tasks.

    Rows and table share the column `key` alone; `by` is a column of the rows that tells the rows of a key apart. At most `share` keys can
    be that frequent, so the list of them is broadcast; the table's rows of these keys are repeated once for each part.
    Frequencies are counted on `stats`, a cheaper table with the same keys as the rows, where it is given.
    """
    stats = rows if stats is None else stats
    least = max(1, stats.count() // share)
    hot = stats.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least).where(F.col(key).isNotNull())
    hot = checkpointed(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    if hot.isEmpty():
        return rows.join(table, key, how)
    few = F.broadcast(hot)
    dealt = rows.join(few, rows[key] == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by, F.lit(61)), F.col("_parts")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    repeated = table.join(few, table[key] == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_hot", "_parts")
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def broadcast_if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, counted first; beyond that joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parts_for(df: DataFrame) -> int:
    """Shuffle partitions of the session, for exchanges whose partition is handed whole to Python."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
