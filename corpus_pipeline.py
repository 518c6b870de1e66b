"""The corpus pipeline: five stages from raw documents to sampled token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import language_id, minhash, mixing, piece_sampling, suffix_dedup
from brindle.llm.queries import documents, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; lang becomes the language found. Rejected documents go."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    found = language_id.identify_languages(docs.select(*COLUMNS), model).where("not rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of near duplicates, once; documents without words all stay."""
    found = minhash.near_duplicates(docs, carry=["doc_id"])
    keep = found.where("node is not null and doc_id <=> class_id").select(F.col("doc_id").alias("_id"), F.col("node").alias("_n")).distinct()
    keyed = docs.select(*COLUMNS).withColumn("_node", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(worded).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_n")), "left_semi").dropDuplicates(["doc_id", "_node"])
    return kept.select(*COLUMNS).unionAll(keyed.where(~worded).select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 100-byte strings; those left without words go."""
    found = suffix_dedup.remove_repeats(docs, carry=["doc_id", "lang", "source"])
    kept = found.where(F.col("n_removed").eqNullSafe(0) | F.coalesce(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document taken in part is cut after its last taken word."""
    taken = mixing.take(mixing.mix(docs, carry=COLUMNS))
    return taken.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document."""
    return piece_sampling.encode_sampled(docs, piece_model(), carry=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("language_id", identify),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("piece_sampling", encode),
]

#: Learned centroids, hashed signatures and sampled pieces have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for _, stage in STAGES:
        out = stage(spark, out, sf_dir)
    return out
