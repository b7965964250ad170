"""From raw documents to token ids: each stage reads what the one before has written.

Quality rules drop documents, line dedup edits texts, near-dedup keeps one document of each group, decontamination
drops documents, and the last stage encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, decontam, line_dedup, minhash, quality
from attestra.session import durable

WIDTH = 5  # words in a shingle of the near-dedup stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.quality_rules(docs).filter("kept").select("_row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that no earlier line repeats; ``n_chars`` follows the text."""
    out = line_dedup.deduplicated(docs)
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_dropped") > 0, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    found = minhash.near_duplicates(docs, WIDTH)
    gone = durable(found.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(line_dedup.sent(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark passage as a twentieth or more of their words."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every document, and the digest of the text they decode to."""
    rows = bpe.encoded(docs, keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs


#: SQL cannot express byte pair encoding; tests/llm/test_pipeline.py compares the rows with a brute-force version.
ORACLE_SQL = None
