"""Nearest-centroid language identification.

A text becomes a normalised TF-IDF vector of its letter bigrams and trigrams (lower case, everything
else is a gap), hashed to `dims` places. Document frequencies cover every training row. Several
centroids per language come from spherical k-means over a sample of at most `per_lang` training
rows of the language (the documented bound of the fit), taken by the smallest row hashes. A text
gets the language of the centroid of highest cosine; ties go to the first language by code point. It
is rejected if that cosine is below the centroid's threshold, which lies well under the low quantile
of the cosines of the sample. Only document frequencies (`dims` numbers) and centroids
(`clusters` x `dims` numbers a language) reach the driver and the tasks.

Nulls and texts without letters: `und`, score 0, rejected. A null language never trains. With no
training row at all every text is `und`. Repeated rows get equal results. Extra columns are carried;
columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import ROW, U64, broadcast_if_small, checkpointed, column, kept_columns, mapped, mix64, named, packed, record, text_slices, unpacked, with_fields

UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    centroids: np.ndarray  # a row each, of length 1
    lang_of: np.ndarray
    threshold: np.ndarray
    idf: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def gram_counts(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts, a row for each text, and whether the text has a letter."""
    joined = "\n".join(texts).lower()
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) != int(lengths.sum()) + len(texts) - 1:  # lower case of some letters is longer
        lowered = [t.lower() for t in texts]
        lengths = np.fromiter((len(t) for t in lowered), np.int64, len(texts))
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), lengths + 1)[: len(points)]
    letter = _letters()[points]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    c = np.where(letter, points, np.uint32(0)).astype(U64)
    c = np.concatenate([np.zeros(1, U64), c, np.zeros(1, U64)])
    mid = np.flatnonzero(letter)
    with np.errstate(over="ignore"):
        pair = c[mid + 1] * U64(0x9E3779B97F4A7C15) + c[mid + 2] * U64(0xC2B2AE3D27D4EB4F)
        shift = U64(64 - dims.bit_length() + 1)
        bi = mix64(pair + U64(1)) >> shift
        tri = mix64(pair + c[mid] * U64(0x165667B19E3779F9) + U64(2)) >> shift
    at = row[mid] * dims
    both = np.concatenate([at + bi.astype(np.int64), at + tri.astype(np.int64)])
    return np.bincount(both, minlength=len(texts) * dims).reshape(len(texts), dims), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def _text_rows(batch: pa.RecordBatch, name: str, target: int = 1 << 19) -> Iterator[tuple[int, int, list[str]]]:
    texts = column(batch, name)
    for lo, hi, _, _ in text_slices(texts, target):
        for at in range(lo, hi, 512):
            to = min(hi, at + 512)
            yield at, to, [t or "" for t in texts.slice(at, to - at).to_pylist()]


def held_out(row_id: str = "doc_id") -> Column:
    """True for the third of the ids that never trains; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.encode(F.col(row_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; up to k centroids of length 1."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    best = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        nxt = int(np.argmin(best))
        if best[nxt] > 0.999:
            break
        chosen.append(nxt)
        best = np.maximum(best, v @ v[nxt])
    c = v[chosen].copy()
    for _ in range(rounds):
        owner = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (owner == j).any():
                s = v[owner == j].sum(axis=0)
                c[j] = s / max(float(np.sqrt((s * s).sum())), 1e-12)
    return c


def fit(training: DataFrame, text: str = "text", lang: str = "lang", dims: int = 4096, clusters: int = 4, per_lang: int = 300, slack: float = 0.5) -> Model:
    """Fit on all rows of training (frequencies) and a bounded sample of them (centroids)."""
    training = training.where(named(lang).isNotNull()).select(named(lang).alias("lang"), named(text).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for _, _, texts in _text_rows(batch, "text"):
                counts, has = gram_counts(texts, dims)
                total += (counts > 0).sum(axis=0)
                n += int(has.sum())
        out = pa.schema([("dim", pa.int32()), ("df", pa.int64())])
        yield record(out, np.arange(-1, dims), np.concatenate([[n], total]))

    seen = {r["dim"]: r["df"] for r in training.select("text").transform(mapped(frequencies, "dim int, df long")).groupBy("dim").agg(F.sum("df").alias("df")).collect()}
    n = seen.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([seen.get(i, 0) for i in range(dims)]))).astype(np.float32) + np.float32(1)

    sizes = broadcast_if_small(checkpointed(training.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))))
    drawn = training.withColumn("_h", F.xxhash64("text", F.lit(17))).join(sizes, "lang")
    drawn = drawn.where(F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53)) < F.lit(2.0 * per_lang) / F.col("_n"))
    distinct = drawn.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    sample = distinct.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= per_lang).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float32()))])

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = column(batch, "lang")
            for lo, hi, texts in _text_rows(batch, "text"):
                counts, has = gram_counts(texts, dims)
                v = vectors(counts, idf)
                keep = np.flatnonzero(has)
                yield record(schema, langs.slice(lo, hi - lo).take(pa.array(keep)), [row for row in v[keep]])

    fitted = pa.schema([("lang", pa.string()), ("centroid", pa.list_(pa.float32())), ("threshold", pa.float64())])

    def centroids(group: pa.Table) -> pa.Table:
        v = np.array(group.column("vector").to_pylist(), np.float32)
        v = v[np.lexsort(v[:, :8].T)]
        c = cluster(v, clusters)
        sims = v @ c.T
        owner, best = sims.argmax(axis=1), sims.max(axis=1)
        low = float(np.quantile(best, 0.01))
        limit = [slack * min(low, float(best[owner == j].min()) if (owner == j).any() else low) for j in range(len(c))]
        name = group.column("lang")[0].as_py()
        return pa.Table.from_arrays([pa.array([name] * len(c)), pa.array([row for row in c], type=pa.list_(pa.float32())), pa.array(limit)], schema=fitted)

    rows = sample.transform(mapped(vectorise, "lang string, vector array<float>")).groupBy("lang").applyInArrow(centroids, "lang string, centroid array<float>, threshold double").collect()
    rows.sort(key=lambda r: (r["lang"], r["centroid"]))
    langs = sorted({r["lang"] for r in rows})
    where = {name: i for i, name in enumerate(langs)}
    return Model(
        langs,
        np.array([r["centroid"] for r in rows], np.float32).reshape(len(rows), dims),
        np.array([where[r["lang"]] for r in rows], np.int64),
        np.array([r["threshold"] for r in rows], np.float64),
        idf,
    )


def classify(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and whether it is rejected, for each text."""
    counts, has = gram_counts(texts, len(model.idf))
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    sims = vectors(counts, model.idf) @ model.centroids.T
    best = sims.argmax(axis=1)
    score = np.where(has, np.clip(sims.max(axis=1), 0, 1), 0).astype(np.float64)
    rejected = ~has | (score < model.threshold[best])
    return [model.langs[model.lang_of[b]] if ok else UNDETERMINED for b, ok in zip(best, has, strict=True)], score, rejected


def identify_languages(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1) and rejected."""
    made = ["lang_pred", "score", "rejected"]
    carry = kept_columns(df, None, made)
    source = df.select(packed(carry), named(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores, gone = [np.zeros(0)], [np.zeros(0, bool)]
            for _, _, texts in _text_rows(batch, "_text"):
                a, b, c = classify(texts, model)
                langs += a
                scores.append(b)
                gone.append(c)
            arrays = [column(batch, ROW), pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(gone))]
            yield pa.RecordBatch.from_arrays(arrays, names=[ROW, *made])

    return unpacked(source.transform(mapped(run, with_fields(source, [ROW], "lang_pred string, score double, rejected boolean"))), carry, *made)
