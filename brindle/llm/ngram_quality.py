"""Perplexity bands from modified Kneser-Ney models of code points, with plain quality rules.

Spark counts the strings of `ORDER` code points of every document, apart for each language and each half of the documents (by the hash of the
text, so equal texts are in one half). A document is scored by the model of its language that was counted on the other half, so no document
is judged by counts of its own. Lower orders use continuation counts, discounts come from the counts of counts of each order, and the
probabilities of each order are joined to those of the next lower one, all as Spark tables keyed by language: no language is merged with
another, no string is folded or left out, and the tables grow with the text.

For scoring, strings and contexts are hashed to 64 bits and held as sorted arrays with their log probabilities and back-off weights. While all
models together have at most `most_entries` entries (12 bytes each; counted first) the arrays are broadcast. Beyond that, documents go to blocks
of about `BLOCK_BYTES` by hash, each block asks the table for the strings it has, and is scored with the arrays of the answers: the same
lookups, at the price of moving the texts.

A document is rejected if it fails the base rules or if its perplexity leaves its language's band: `spread`
interquartile ranges beyond the quartiles of the log perplexities of that language's documents that
pass the base rules. Quartiles come from exact counts of log perplexities in steps of 1/256 bit.

Nulls and texts without words have no words, perplexity null and fail the base rules. A null language is a language
of its own. Where the other half has no text of a language, its documents have no perplexity and the base rules alone decide. Repeated
rows count and get equal results. An empty table gives an empty result. Extra columns are carried; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import (
    ROW, U64, WORD_BYTE, as_long, broadcast_if_small, checkpointed, column, kept_columns, mapped, mix64, named, packed, record, reuse_memory, span_hashes, text_slices, unpacked, with_fields, word_spans,
)

ORDER = 4
FLUSH = 1 << 21  # distinct strings that a task holds before it gives them on
STEP = 256
BLOCK_BYTES = 32 << 20
MOST_ENTRIES = 6_000_000
#: Fixed values of the base rules.
SYMBOL_CHARS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOL_CHARS)] = True
#: A string of code points is two numbers of 21-bit places: the newest three in lo, older ones in hi.
_PLACE = U64((1 << 21) - 1)
_LO_BITS = 63


def strings_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the string of ORDER code points that ends at each character of a slice, and the text of each; before a text's start are zeros."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(U64)
    bounds = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
    sizes = np.diff(bounds)
    place = np.arange(len(points)) - np.repeat(bounds[:-1], sizes)
    hi, lo = np.zeros(len(points), U64), points.copy()
    for back in range(1, ORDER):
        older = np.zeros(len(points), U64)
        older[back:] = points[: len(points) - back]
        older[place < back] = 0
        if back < 3:
            lo |= older << U64(21 * back)
        else:
            hi |= older << U64(21 * (back - 3))
    return hi, lo, np.repeat(np.arange(len(sizes)), sizes)


def newest(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The last k code points of the strings."""
    if k <= 3:
        return np.zeros_like(hi), lo & U64((1 << (21 * k)) - 1)
    return hi & U64((1 << (21 * (k - 3))) - 1), lo


def context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings without their last code point."""
    return hi >> U64(21), (lo >> U64(21)) | ((hi & _PLACE) << U64(42))


def entry_keys(hi: np.ndarray, lo: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """Hashes under which entries are held: kind 2 * k for strings of k code points, 2 * k + 1 for contexts of k."""
    with np.errstate(over="ignore"):
        return mix64(mix64(hi * U64(0x9E3779B97F4A7C15) + np.asarray(kind).astype(U64)) + lo)


_slots = np.zeros(1 << 20, np.int32)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct key, and for each key which of them it is.

    Keys are written to a table by their hash, and those that find themselves there are done; the few that share a place with another go round again.
    """
    chosen, left, again = np.empty(len(keys), np.int64), np.arange(len(keys)), keys
    while len(left):
        slot = (again >> U64(44)).astype(np.int32)
        _slots[slot] = left
        there = _slots[slot]
        found = keys[there] == keys[left]
        chosen[left[found]] = there[found]
        left = left[~found]
        again = mix64(again[~found] ^ U64(0x9E3779B97F4A7C15))
    first = np.zeros(len(keys), bool)
    first[chosen] = True
    return np.flatnonzero(first), (np.cumsum(first) - 1)[chosen]


def half_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(text, F.lit(47)), F.lit(2)).cast("int")


def _groups(langs: list, halves: np.ndarray, known: dict) -> np.ndarray:
    """A number for each row's (language, half), the same through a task."""
    return np.fromiter((known.setdefault((a, b), len(known)) for a, b in zip(langs, halves.tolist(), strict=True)), np.int64, len(langs))


def count_strings(docs: DataFrame) -> DataFrame:
    """(lang, half, hi, lo, n) over all documents; docs has lang, half and text."""
    schema = pa.schema([("lang", pa.string()), ("half", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        known: dict = {}
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            group, hi, lo, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            one, which = distinct(entry_keys(hi, lo, group))
            names, of = list(known), group[one]
            langs = pa.array([x[0] for x in names], pa.string()).take(pa.array(of))
            yield record(schema, langs, np.array([x[1] for x in names])[of], as_long(hi[one]), as_long(lo[one]), np.bincount(which, weights=n).astype(np.int64))

        for batch in batches:
            groups = _groups(column(batch, "lang").to_pylist(), np.asarray(column(batch, "half")), known)
            for at, to, data, offsets in text_slices(column(batch, "text")):
                if len(data):
                    hi, lo, row = strings_of(data, offsets)
                    group = groups[at:to][row]
                    one, which = distinct(entry_keys(hi, lo, group))
                    held.append((group[one], hi[one], lo[one], np.bincount(which)))
                    if sum(len(x[0]) for x in held) >= FLUSH:
                        yield from flush()
        if held:
            yield from flush()

    counted = docs.select("lang", "half", "text").transform(mapped(run, "lang string, half int, hi long, lo long, n long"))
    return counted.groupBy("lang", "half", "hi", "lo").agg(F.sum("n").alias("n"))


def _newest(k: int) -> tuple[Column, Column]:
    if k <= 3:
        return F.lit(0).cast("long"), F.col("lo").bitwiseAND(F.lit((1 << (21 * k)) - 1))
    return F.col("hi").bitwiseAND(F.lit((1 << (21 * (k - 3))) - 1)), F.col("lo")


MODEL = ["lang", "half"]


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(lang, half, kind, hi, lo, value): the log probabilities of all strings and the log back-off weights of all contexts.

    kind is 2 * k for a string of k code points and 2 * k + 1 for a context of k; kind 0 is the probability of an unseen code point, and the
    back-off weight of the empty context has kind 1. A discount of a count class comes from the counts of counts 1 to 4 of its order.
    """
    orders = {ORDER: checkpointed(counted.select(*MODEL, "hi", "lo", F.col("n").cast("double").alias("c")))}
    for k in range(ORDER - 1, 0, -1):
        hi, lo = _newest(k)
        orders[k] = checkpointed(orders[k + 1].groupBy(*MODEL, hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("c")))
    unseen = orders[1].groupBy(*MODEL).agg((-F.log(F.count(F.lit(1)) + 1)).alias("value"))
    out = [unseen.select(*MODEL, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), "value")]
    lower = unseen.select(*MODEL, F.exp("value").alias("lower"))
    for k in range(1, ORDER + 1):
        seen = [F.greatest(F.lit(1.0), F.sum((F.col("c") == i).cast("double"))).alias(f"n{i}") for i in range(1, 5)]
        of = orders[k].groupBy(*MODEL).agg(*seen)
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        off = [F.least(F.greatest(F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
        discounts = of.select(*[F.col(c).alias(f"_{c}") for c in MODEL], *off)
        same_model = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("half") == F.col("_half"))
        rows = orders[k].join(broadcast_if_small(discounts), same_model).drop("_lang", "_half")
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        rows = rows.withColumn("chi", F.shiftrightunsigned("hi", 21)).withColumn("clo", F.shiftrightunsigned("lo", 21).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << 21) - 1)), 42)))
        of_context = Window.partitionBy(*MODEL, "chi", "clo")
        rows = rows.withColumn("total", F.sum("c").over(of_context)).withColumn("back", F.sum("d").over(of_context) / F.col("total"))
        rows = rows.select(*MODEL, "hi", "lo", "chi", "clo", "c", "d", "total", "back")
        if k == 1:
            met = rows.join(broadcast_if_small(lower.toDF("_lang", "_half", "lower")), same_model)
        else:
            shi, slo = _newest(k - 1)
            below = lower.select(F.col("lang").alias("_lang"), F.col("half").alias("_half"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "lower")
            met = rows.withColumn("shi", shi).withColumn("slo", slo).join(below, same_model & (F.col("shi") == F.col("_hi")) & (F.col("slo") == F.col("_lo")))
        done = checkpointed(met.select(*MODEL, "hi", "lo", "chi", "clo", "back", ((F.col("c") - F.col("d")) / F.col("total") + F.col("back") * F.col("lower")).alias("p")))
        out.append(done.select(*MODEL, F.lit(2 * k).alias("kind"), "hi", "lo", F.log("p").alias("value")))
        contexts = done.groupBy(*MODEL, "chi", "clo").agg(F.first("back").alias("back"))
        out.append(contexts.select(*MODEL, F.lit(2 * k - 1).alias("kind"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.log("back").alias("value")))
        lower = done.select(*MODEL, "hi", "lo", F.col("p").alias("lower"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def hashed(model: DataFrame) -> DataFrame:
    """(lang, half, key, value): the entries under their hashes."""
    schema = pa.schema([("lang", pa.string()), ("half", pa.int32()), ("key", pa.int64()), ("value", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, kind = (column(batch, c).to_numpy() for c in ("hi", "lo", "kind"))
            yield record(schema, column(batch, "lang"), column(batch, "half"), as_long(entry_keys(hi.view(U64), lo.view(U64), kind)), column(batch, "value").to_numpy().astype(np.float32))

    return model.transform(mapped(run, "lang string, half int, key long, value float"))


Arrays = tuple[np.ndarray, np.ndarray]


def log_probabilities(hi: np.ndarray, lo: np.ndarray, arrays: Arrays) -> np.ndarray:
    """The log probability of the last code point of each string by back-off through sorted arrays of keys and values."""
    keys, values = arrays

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return hit, np.where(hit, values[at], np.float32(0)).astype(np.float64)

    out, left = np.zeros(len(hi)), np.arange(len(hi))
    for k in range(ORDER, -1, -1):
        some = newest(hi[left], lo[left], k) if k else (np.zeros(len(left), U64), np.zeros(len(left), U64))
        hit, value = find(entry_keys(*some, 2 * k))
        out[left] += value
        if k:
            left = left[~hit]
            if not len(left):
                break
            out[left] += find(entry_keys(*context(*newest(hi[left], lo[left], k)), 2 * k - 1))[1]
    return out


def wanted_keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """All keys that log_probabilities may look up for the strings."""
    out = [entry_keys(np.zeros(1, U64), np.zeros(1, U64), 0)]
    for k in range(1, ORDER + 1):
        some = newest(hi, lo, k)
        out += [entry_keys(*some, 2 * k), entry_keys(*context(*some), 2 * k - 1)]
    return np.unique(np.concatenate(out))


def entropies(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, arrays_of: dict[int, Arrays]) -> np.ndarray:
    """Bits a character of each text of a slice under its group's model; not a number where there is no model or no text."""
    rows = len(offsets) - 1
    out = np.full(rows, np.nan)
    if not len(data):
        return out
    hi, lo, row = strings_of(data, offsets)
    chars = np.bincount(row, minlength=rows)
    of = groups[row]
    one, which = distinct(entry_keys(hi, lo, of))
    value = np.full(len(one), np.nan)
    for g in np.unique(groups):
        if g in arrays_of:
            mine = np.flatnonzero(of[one] == g)
            value[mine] = log_probabilities(hi[one[mine]], lo[one[mine]], arrays_of[g])
    total = np.bincount(row, weights=value[which], minlength=rows)
    there = chars > 0
    out[there] = -total[there] / chars[there] / np.log(2)
    return out


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each row in windows of three words that the row has at least twice."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    if len(hashes) < 3:
        return np.zeros(len(n), np.int64)
    at = np.flatnonzero(row[2:] == row[:-2])
    with np.errstate(over="ignore"):
        key = mix64(mix64(mix64(hashes[at] + U64(1)) + hashes[at + 1]) + hashes[at + 2] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(hashes) + 3, bool)
    twice[at[order[1:][same]]] = True
    twice[at[order[:-1][same]]] = True
    covered = twice[:-3].copy()
    covered[1:] |= twice[:-4]
    covered[2:] |= twice[:-5]
    return np.bincount(row[covered], minlength=len(n)).astype(np.int64)


def _duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return n


def base_figures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the texts of a slice."""
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = per_row(WORD_BYTE[data] & ((data & 0xC0) != 0x80))
    breaks = per_row(data == 0x0A)
    raw = data.tobytes()
    lines = np.zeros(rows, np.int64)
    for i in np.flatnonzero(breaks):
        lines[i] = _duplicate_lines(raw[offsets[i] : offsets[i + 1]].decode("utf-8"))
    return np.diff(first), chars, per_row(_SYMBOL[data]), lines, _repeated_words(span_hashes(data, starts, ends), first)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_base_figures(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df's columns (or those in `carry`) with the base figures alone."""
    carry = kept_columns(df, carry, FIGURES)
    source = df.select(packed(carry), F.coalesce(named(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(column(batch, "text")):
                yield pa.RecordBatch.from_arrays([column(batch.slice(lo, hi - lo), ROW), *map(pa.array, base_figures(data, offsets))], names=[ROW, *FIGURES])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], ", ".join(f"{c} long" for c in FIGURES)))), carry, *FIGURES)


def _scored_batch(batch: pa.RecordBatch, groups: np.ndarray, arrays_of: dict[int, Arrays]) -> Iterator[pa.RecordBatch]:
    for lo, hi, data, offsets in text_slices(column(batch, "text")):
        found = base_figures(data, offsets)
        entropy = entropies(data, offsets, groups[lo:hi], arrays_of)
        part = batch.slice(lo, hi - lo)
        values = pa.array(entropy, mask=np.isnan(entropy) | (found[0] == 0))
        yield pa.RecordBatch.from_arrays([column(part, ROW), column(part, "lang"), *map(pa.array, found), values], names=[ROW, "lang", *FIGURES, "log2_perplexity"])


def _in_place(docs: DataFrame, model: DataFrame, made: str) -> DataFrame:
    """docs scored by models that are broadcast as sorted arrays."""
    table = model.toArrow()
    langs, halves = table.column("lang").to_pylist(), table.column("half").to_numpy()
    numbers: dict = {}
    which = _groups(langs, halves, numbers)
    keys, values = table.column("key").to_numpy().view(U64), table.column("value").to_numpy()
    arrays = {}
    for name, g in numbers.items():
        mine = np.flatnonzero(which == g)
        mine = mine[np.argsort(keys[mine])]
        arrays[name] = (keys[mine], values[mine])
    shared = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        known = {name: i for i, name in enumerate(shared.value)}
        arrays_of = dict(enumerate(shared.value.values()))
        for batch in batches:
            yield from _scored_batch(batch, _groups(column(batch, "lang").to_pylist(), 1 - np.asarray(column(batch, "half")), known), arrays_of)

    return docs.transform(mapped(run, with_fields(docs, [ROW, "lang"], made)))


def _in_blocks(docs: DataFrame, model: DataFrame, made: str) -> DataFrame:
    """docs scored block by block, each with the entries it asks for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("text", "lang"), F.lit(blocks)))
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("half", pa.int32()), ("key", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            groups = _groups(list(zip(column(batch, "block").to_pylist(), column(batch, "lang").to_pylist(), strict=True)), 1 - np.asarray(column(batch, "half")), known)
            for lo, hi, data, offsets in text_slices(column(batch, "text")):
                if not len(data):
                    continue
                a, b, row = strings_of(data, offsets)
                group = groups[lo:hi][row]
                one, _ = distinct(entry_keys(a, b, group))
                for ((block, lang), half), g in known.items():
                    mine = one[group[one] == g]
                    if len(mine):
                        keys = wanted_keys(a[mine], b[mine])
                        yield record(schema, [block] * len(keys), [lang] * len(keys), [half] * len(keys), as_long(keys))

    asked = dealt.select("block", "lang", "half", "text").repartition("block").sortWithinPartitions("block", "lang", "half").transform(mapped(ask, "block long, lang string, half int, key long")).distinct()
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("half") == F.col("_half")) & (F.col("key") == F.col("_key"))
    answers = asked.join(model.toDF("_lang", "_half", "_key", "value"), same).select("block", "lang", "half", "key", "value")
    out = with_fields(docs, [ROW, "lang"], made)

    def score(texts: pa.Table, entries: pa.Table) -> pa.Table:
        known: dict = {}
        which = _groups(entries.column("lang").to_pylist(), entries.column("half").to_numpy(), known)
        keys, values = entries.column("key").to_numpy().view(U64), entries.column("value").to_numpy()
        arrays_of = {}
        for g in known.values():
            mine = np.flatnonzero(which == g)
            mine = mine[np.argsort(keys[mine])]
            arrays_of[g] = (keys[mine], values[mine])
        done = []
        for batch in texts.to_batches():
            done += _scored_batch(batch, _groups(column(batch, "lang").to_pylist(), 1 - np.asarray(column(batch, "half")), known), arrays_of)
        return pa.Table.from_batches(done) if done else texts.select([ROW, "lang"])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def quality(df: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None, spread: float = 3.0, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """df's columns (or those in `carry`) with the base figures, base_failed, log2_perplexity, band_low, band_high and kept."""
    made = [*FIGURES, "base_failed", "log2_perplexity", "band_low", "band_high", "kept"]
    carry = kept_columns(df, carry, made)
    docs = df.select(packed(carry), named(lang).cast("string").alias("lang"), F.coalesce(named(text), F.lit("")).alias("text")).withColumn("half", half_of(F.col("text")))
    model = checkpointed(hashed(kneser_ney(count_strings(docs))))
    types = ", ".join([*(f"{c} long" for c in FIGURES), "log2_perplexity double"])
    scored = (_in_place if model.count() <= most_entries else _in_blocks)(docs, model, types)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    scored = checkpointed(scored.withColumn("base_failed", failed))
    steps = scored.where("not base_failed and log2_perplexity is not null").groupBy("lang", F.floor(F.col("log2_perplexity") * STEP).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang")
    steps = steps.withColumn("reach", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    quartile = lambda q: F.min(F.when(F.col("reach") >= q * F.col("all"), F.col("at"))) / STEP
    bands = steps.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(1 / STEP))
    bands = bands.select(F.col("lang").alias("_lang"), (F.col("q1") - spread * width).alias("band_low"), (F.col("q3") + spread * width + 1 / STEP).alias("band_high"))
    out = scored.join(broadcast_if_small(checkpointed(bands)), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.coalesce(F.col("log2_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return unpacked(out.withColumn("kept", ~F.col("base_failed") & inside), carry, *made)
