"""The training-data queries: each applies its operator to the whole of `documents`."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc_fingerprint, language_id, minhash, mixing, ngram_quality, piece_sampling, sharding, suffix_dedup, token_counts, weak_quality

#: Where the public vocabulary files are; callers can pass another folder.
TOKENIZERS = "/opt/tokenizers"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def piece_model(folder: str = TOKENIZERS) -> bytes:
    return Path(folder, "piece_bpe_32k.model").read_bytes()


def op1_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24, carry=["doc_id"])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify_languages(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), carry=["doc_id"], keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "class_id", "n_links")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(documents(spark, sf_dir).select("doc_id", "text"), piece_model()).drop("text")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "takes")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_sampled(documents(spark, sf_dir), piece_model(), carry=["doc_id"])


def op8_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.quality(documents(spark, sf_dir), carry=["doc_id"])


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.weak_scores(documents(spark, sf_dir), carry=["doc_id"])


def op10_cdc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_fingerprint.compare_edited(documents(spark, sf_dir), carry=["doc_id"])


# parts of the operators that SQL can say


def llm_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.with_base_figures(documents(spark, sf_dir), carry=["doc_id"])


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), carry=["doc_id", "source"])
    per_source = F.sum("taken").alias("taken"), F.max("source_size").alias("source_size"), F.round(F.max("target"), 3).alias("target")
    return mixed.groupBy("source").agg(*per_source)


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_fingerprint.compare_edited(documents(spark, sf_dir), carry=["doc_id"]).select("doc_id", "n_chars", "edited_sha256")


def llm_shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24, carry=["doc_id"]).select("doc_id", "size", "law")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "llm_shard_sizes": "SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, 'bytes' AS law FROM documents",
    "llm_edited_texts": """SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 4) || substr(f, 1, n // 4)) AS edited_sha256 FROM (SELECT doc_id, t, length(t) AS n,
coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "llm_mix_targets": f"""WITH s AS (SELECT source, CAST(sum(len({WORDS})) AS BIGINT) AS n FROM documents GROUP BY 1), w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, n * 3.0 AS cap, (sum(n) OVER () - coalesce(sum(n * 3) OVER q, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER q, 0)) AS level FROM w WINDOW q AS (ORDER BY n * 3.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS share FROM o), t AS (SELECT source, n, least(coalesce(share * w, cap), cap) AS target FROM l)
SELECT source, n AS source_size, round(target, 3) AS target, CAST(least(round(target), n * 3) AS BIGINT) AS taken FROM t""",
    "llm_quality_base": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, word || chr(1) || lead(word) OVER v || chr(1) || lead(word, 2) OVER v AS g FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1), c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) t(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_histogram_sharding,
        op2_language_id,
        op3_suffix_dedup,
        op4_dart_minhash,
        op5_token_counts,
        op6_source_mixing,
        op7_piece_sampling,
        op8_ngram_quality,
        op9_weak_quality,
        op10_cdc_fingerprint,
        llm_quality_base,
        llm_mix_targets,
        llm_edited_texts,
        llm_shard_sizes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
