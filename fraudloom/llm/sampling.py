"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import held_out
from fraudloom.session import cut_lineage


def training_labels(labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label) of documents whose labels may be learned from.

    Held-out ids and null labels go; of several labels of one document the least counts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    return known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))


def hashed_sample(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows with the smallest hash of ``doc_id``; the same rows whatever the partitioning."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sampled_texts(docs: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, label) of the chosen (doc_id, label) rows, written once.

    ``chosen`` holds a bounded sample, so it is broadcast.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return cut_lineage(slim.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))


def class_counts(labels: DataFrame) -> dict[int, int]:
    """Documents of each label."""
    return {r["label"]: r["count"] for r in labels.groupBy("label").count().collect() if r["label"] in (0, 1)}
