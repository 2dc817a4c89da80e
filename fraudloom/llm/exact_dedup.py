"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after A-Z is lower-cased; null counts as
empty. A digest only brings candidates together; what decides is the full content,
which is a grouping key at every stage:

1. rows of one input partition are combined before anything moves (the map side of
   the first aggregation), so a partition sends each content once however often it
   holds it;
2. digest groups, salted by the sending partition, are merged: a content held by
   every partition meets in ``salts`` tasks, not in one;
3. the salts' winners, at most ``salts`` rows of a content, are combined globally.

A digest under which two contents met is replaced by the content itself and the
stages run again, so results never rest on a digest. The winners go back to the rows
by digest: those with 1/4096 of all rows or more are at most 4,096 and broadcast, so
no key of the remaining shuffle join is hot.

Results on awkward input: of equal texts the row with the largest id stays; null ids
are smaller than any id, and a group without ids keeps its rows under ``keep_id``
null. Rows that repeat an id and its text are one document: all carry the same
verdict. Empty and null texts form one group. Other columns are handed through; added
columns evade taken names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import fresh
from fraudloom.session import cut_lineage

#: Tasks among which the copies of one content are dealt out before the global stage.
SALTS = 32
#: Contents with this share of all rows are broadcast: there can be no more than its inverse.
HOT = 4096

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lowered and nothing else; texts of ASCII alone take the engine's faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def mark_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_text: bool = False,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> tuple[DataFrame, str]:
    """``docs`` with a struct (keep_id, group_size, kept, digest) for each row, and the struct's name.

    Without ``keep_text`` the texts stay behind: only ids and digests meet the winners.
    """
    key, name = fresh(docs, "digest"), fresh(docs, "copies")
    keyed = docs.withColumn(key, digest(normalised(F.col(text))))
    found = cut_lineage(_winners(keyed, doc_id, text, key, salts))
    if not found.filter("contents > 1").isEmpty():
        keyed = _content_for_digest(keyed, found.filter("contents > 1"), text, key)
        found = cut_lineage(_winners(keyed, doc_id, text, key, salts))
    rows = keyed if keep_text else cut_lineage(keyed.drop(text))
    total = found.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    won = found.select(F.col("digest").alias(key), F.struct("keep_id", "group_size").alias(name))
    hot = F.broadcast(won.filter(F.col(f"{name}.group_size") * HOT >= total))
    cold = won.filter(F.col(f"{name}.group_size") * HOT < total)
    joined = rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
    verdict = F.struct(
        f"{name}.keep_id", f"{name}.group_size",
        F.col(doc_id).eqNullSafe(F.col(f"{name}.keep_id")).alias("kept"), F.col(key).alias("digest"),
    )
    return joined.select(*(c for c in rows.columns if c != key), verdict.alias(name)), name


def remove_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has too."""
    marked, name = mark_copies(docs, doc_id, text, keep_text=True, salts=salts)
    return marked.filter(f"`{name}`.kept").select(*docs.columns)


def _winners(keyed: DataFrame, doc_id: str, text: str, key: str, salts: int) -> DataFrame:
    """(digest, contents, keep_id, group_size): how many contents met under a digest, and the last row of them."""
    rows = keyed.select(
        F.col(key).alias("digest"), normalised(F.col(text)).alias("content"), F.col(doc_id).alias("id"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
    )
    merged = rows.groupBy("digest", "salt", "content").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    contents = merged.repartition("digest").groupBy("digest", "content").agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    return contents.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("id").alias("keep_id"), F.sum("n").alias("group_size")
    )


def _content_for_digest(keyed: DataFrame, clashes: DataFrame, text: str, key: str) -> DataFrame:
    """Rows whose digest stands for several contents get their content as key; the mark keeps both kinds of keys apart."""
    mark = fresh(keyed, "clash")
    clashed = clashes.select(F.col("digest").alias(key), F.lit(True).alias(mark))
    own = F.concat(F.lit("="), normalised(F.col(text)))
    return keyed.join(clashed, key, "left").withColumn(key, F.when(F.col(mark), own).otherwise(F.col(key))).drop(mark)
