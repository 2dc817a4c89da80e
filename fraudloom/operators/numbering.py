"""Consecutive numbers for sorted rows, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.plans.sizing import sized
from fraudloom.session import cut_lineage

POSITION_BITS = 33  # fixed value: low bits of monotonically_increasing_id


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with 0-based positions in ``order``.

    The sort leaves ordered range partitions; each numbers its own rows, and the
    driver adds up one row count per partition.
    """
    stored = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", POSITION_BITS)
    spans = stored.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    seen, shifts = 0, []
    for row in sorted(spans, key=lambda r: r["first"]):
        shifts.append((row["p"], seen - row["first"]))
        seen += row["n"]
    shift = df.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    placed = stored.withColumn("_part", part).join(sized(shift, len(shifts), 16), "_part")
    return placed.withColumn(out, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
