"""Quality scores from weak labels.

Overlapping heuristic labellers each vote good, bad or nothing on every document. Expectation-maximisation over
the counts of all vote patterns (at most 3 ** labellers rows, whatever the corpus) estimates how often each labeller
gives each vote for good and for bad documents, and the share of good ones. A document's posterior follows
from its pattern. A linear scorer over hashed words and word shapes is then fitted by logistic regression to
the posteriors of a sample of at most `fit_rows` documents (the documented bound of the fit), taken by the
smallest row hashes, and scores every document; `kept` is a score of at least `threshold`.

Nulls and texts without words: every labeller that needs words abstains, the score is 0 and they are not kept. Equal
texts get equal results. With no documents the result is empty. Extra columns are carried; columns named like the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import ROW, U64, WORD_BYTE, column, kept_columns, mapped, mix64, named, packed, record, reuse_memory, span_hashes, text_slices, unpacked, with_fields, word_spans
from .ngram_quality import base_figures

LABELLERS = ("length", "symbols", "marks_in_words", "repeats", "lines", "capitals", "word_length", "sentences", "variety", "bars")
WORD_BITS, SHAPE_BITS = 13, 12
FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1
GOOD, BAD, NONE = 1, 2, 0

_CLASS = np.ones(256, np.uint8)  # letters beyond ASCII count as small ones
_CLASS[:128] = [0 if not WORD_BYTE[i] else 1 if chr(i).islower() else 2 if chr(i).isupper() else 3 if chr(i).isdigit() else 4 for i in range(128)]
_SHAPE = np.where(_CLASS == 4, np.arange(256) % 251 + 8, _CLASS).astype(U64)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of votes for each text of a slice."""
    n_words, word_chars, n_symbols, dup_lines, repeats = (x.astype(np.float64) for x in base_figures(data, offsets))
    starts, ends, first = word_spans(data, offsets)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    def per_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[first[1:]] - sums[first[:-1]]).astype(np.float64)

    kind = _CLASS[data]
    marks, capitals, letters = per_row(kind == 4), per_row(kind == 2), per_row((kind == 1) | (kind == 2))
    lines = per_row(data == 0x0A) + 1
    final = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    stops = per_words((final == 0x2E) | (final == 0x21) | (final == 0x3F))
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    with np.errstate(over="ignore"):
        order = np.argsort(mix64(hashes + row.astype(U64) * U64(0x9E3779B97F4A7C15)))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    variety = np.bincount(r[fresh], minlength=len(n_words)) / np.maximum(n_words, 1)
    words = np.maximum(n_words, 1)
    length = word_chars / words
    bars = per_row(data == 0x7C)

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(n_words == 0, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))

    columns = {
        "length": vote(n_words >= 50, n_words < 20),
        "symbols": vote(n_symbols <= 0.02 * words, n_symbols > 0.1 * words),
        "marks_in_words": vote(marks <= 0.35 * words, marks > 0.8 * words),
        "repeats": vote(repeats <= 0.05 * words, repeats > 0.3 * words),
        "lines": vote(dup_lines <= 0.05 * lines, dup_lines > 0.3 * lines),
        "capitals": vote(capitals <= 0.1 * np.maximum(letters, 1), capitals > 0.3 * np.maximum(letters, 1)),
        "word_length": vote((length >= 3) & (length <= 9), (length < 2.5) | (length > 12)),
        "sentences": vote((stops >= 0.02 * words) & (stops <= 0.3 * words), stops < 0.005 * words),
        "variety": vote(variety >= 0.3, (variety < 0.15) & (n_words < 2000)),
        "bars": vote(bars == 0, bars > 0.05 * words),
    }
    return np.stack([columns[c] for c in LABELLERS], axis=1)


def pattern_codes(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, vote shares (labeller, good or bad, vote) and the share of good documents.

    Starts from weighted votes in which two bad ones outweigh all good ones: labellers see one kind of fault each, so
    most of them call a bad document good.
    """
    votes_of = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    hot = np.stack([votes_of == v for v in range(3)], axis=2).astype(np.float64)
    lead = 1.5 + 0.1 * hot[:, :, GOOD].sum(axis=1) - 1.5 * hot[:, :, BAD].sum(axis=1)
    posterior = 1 / (1 + np.exp(-np.clip(lead, -8, 8)))
    share, rates = 0.5, np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        for c, p in enumerate((1 - posterior, posterior)):
            weight = p * counts
            rates[:, c] = (np.einsum("i,ijk->jk", weight, hot) + 1.0) / (weight.sum() + 3.0)
        share = float((posterior * counts).sum() + 1) / (counts.sum() + 2)
        log = np.einsum("ijk,jk->i", hot, np.log(rates[:, 1]) - np.log(rates[:, 0])) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        moved = float(np.abs(new - posterior).max(initial=0))
        posterior = new
        if moved < 1e-9:
            break
    return posterior, rates, share


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of the normalised hashed features of the texts of a slice."""
    starts, ends, first = word_spans(data, offsets)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    word = (span_hashes(data, starts, ends) >> U64(64 - WORD_BITS)).astype(np.int64)
    shape = np.zeros(len(starts), U64)
    with np.errstate(over="ignore"):
        for back in (1, 2, 3, 4):
            at = ends - back
            shape = mix64(shape + np.where(at >= starts, _SHAPE[data[np.maximum(at, 0)]] if len(data) else U64(0), U64(7)))
        shape = mix64(shape + (_SHAPE[data[starts]] if len(starts) else U64(0)))
    shaped = (shape >> U64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    key, count = np.unique(np.concatenate([row * FEATURES + word, row * FEATURES + shaped]), return_counts=True)
    r, f = key // FEATURES, key % FEATURES
    w = np.log1p(count) * np.where(f >= 1 << WORD_BITS, 3.0, 1.0)
    norm = np.sqrt(np.bincount(r, weights=w * w, minlength=len(n)))
    return r, f, w / np.maximum(norm[r], 1e-12)


def train(rows: np.ndarray, at: np.ndarray, weight: np.ndarray, goal: np.ndarray, rounds: int = 300, rate: float = 8.0, shrink: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the constant."""
    w = np.zeros(FEATURES)
    look = w.copy()
    for i in range(rounds if len(goal) else 0):
        z = np.bincount(rows, weights=weight * look[at], minlength=len(goal)) + look[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal
        slope = np.bincount(at, weights=weight * error[rows], minlength=FEATURES) / len(goal) + shrink * look
        slope[-1] = error.mean()
        new = look - rate * slope
        look = new + i / (i + 3) * (new - w)
        w = new
    return w


def weak_scores(df: DataFrame, text: str = "text", carry: list[str] | None = None, fit_rows: int = 4000, threshold: float = 0.5) -> DataFrame:
    """df's columns (or those in `carry`) with votes (one digit a labeller: 0 none, 1 good, 2 bad), posterior, score and kept."""
    made = ["votes", "posterior", "score", "kept"]
    carry = kept_columns(df, carry, made)
    docs = df.select(named(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(column(batch, "text")):
                np.add.at(total, pattern_codes(votes(data, offsets)), 1)
        seen = np.flatnonzero(total)
        yield record(schema, seen, total[seen])

    counted = docs.transform(mapped(count, "pattern long, n long")).groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    patterns, counts = counted.column("pattern").to_numpy(), counted.column("n").to_numpy()
    posterior, _, _ = estimate(patterns, counts)
    table = np.full(3 ** len(LABELLERS), 0.5)
    table[patterns] = posterior
    total = int(counts.sum())
    drawn = docs.where(F.col("text").isNotNull()).withColumn("_h", F.xxhash64("text", F.lit(29)))
    drawn = drawn.where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < F.lit(2.0 * fit_rows / max(total, 1)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("goal", pa.float64()), ("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32()))])
        for batch in batches:
            hashes = column(batch, "_h").to_numpy()
            for lo, hi, data, offsets in text_slices(column(batch, "text")):
                goal = table[pattern_codes(votes(data, offsets))]
                r, f, w = features(data, offsets)
                bounds = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                yield record(schema, hashes[lo:hi], goal, pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(w.astype(np.float32))))

    extracted = drawn.transform(mapped(extract, "h long, goal double, at array<int>, weight array<float>"))
    sample = extracted.groupBy("h").agg(*[F.first(c).alias(c) for c in ("goal", "at", "weight")]).orderBy("h").limit(fit_rows).toArrow()
    sizes = np.asarray(pa.compute.list_value_length(sample.column("at").combine_chunks())).astype(np.int64)
    flat_at, flat_weight = (np.asarray(pa.compute.list_flatten(sample.column(c).combine_chunks())) for c in ("at", "weight"))
    model = train(np.repeat(np.arange(sample.num_rows), sizes), flat_at.astype(np.int64), flat_weight.astype(np.float64), sample.column("goal").to_numpy())
    source = df.select(packed(carry), named(text).alias("_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(column(batch, "_text")):
                v = votes(data, offsets)
                r, f, w = features(data, offsets)
                z = np.bincount(r, weights=w * model[f], minlength=hi - lo) + model[-1]
                empty = np.bincount(r, minlength=hi - lo) == 0
                s = np.where(empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
                p = np.where(empty, 0.0, table[pattern_codes(v)])
                names = ["".join(map(str, x)) for x in v.tolist()]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([column(part, ROW), pa.array(names, pa.string()), pa.array(p), pa.array(s), pa.array(s >= threshold)], names=[ROW, *made])

    return unpacked(source.transform(mapped(score, with_fields(source, [ROW], "votes string, posterior double, score double, kept boolean"))), carry, *made)
