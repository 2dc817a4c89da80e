"""The training-data pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.llm import decontaminate, minhash_hamming, quality_rules, secret_scan, wfst_pieces
from fraudloom.llm.common import table
from fraudloom.session import cut_lineage, owned_tables, shared_folder

#: Shingles and similarity of the near-duplicate stage: five words, 0.8 or more.
NEAR = minhash_hamming.Plan(words=5, percent=80, n=60, chunks=15, distance=29)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return minhash_hamming.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too many words inside benchmark windows go; the others stay as they are."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, the text decoded from them, and whether that is the document's text.

    The ids are written first: encoding and decoding in one stage would take two
    Python workers for each core, which then stay with their memory. Of the text
    only the digest is written beside them.
    """
    found, name = wfst_pieces.encode_documents(docs)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    encoded = cut_lineage(found.select("doc_id", "source", "lang", digest, f"{name}.*"))
    back, decoded = wfst_pieces.decode_documents(encoded)
    same = F.unhex(F.sha2(decoded, 256)) == F.col("digest")
    return back.withColumn("round_trip", same).drop("digest")


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", pieces),
]

#: Shortest paths through transducers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with owned_tables(spark):  # what a stage writes on the way goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
