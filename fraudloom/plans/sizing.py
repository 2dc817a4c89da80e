"""Measured join choices: what may be broadcast and which keys need salting.

The numbers steer the physical plan and never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 32
#: A key is hot from this share of the rows, or from a few partitions' worth of them if that is less.
HOT_SHARE = 1 / 64
LEAST_HOT_SHARE = 1 / 4096
SALT_FROM_ROWS = 5_000_000
_ROW_OVERHEAD = 64


@dataclass(frozen=True)
class KeyProfile:
    """Counted size of a one-row-per-key table and the keys holding many rows.

    At most ``1 / LEAST_HOT_SHARE`` keys can be hot, so ``hot`` is always short.
    """

    distinct: int
    max_bytes: int
    hot: tuple = ()
    hot_null: bool = False

    def fits_broadcast(self, value_columns: int, limit: int | None = None) -> bool:
        width = self.max_bytes + 8 * value_columns + _ROW_OVERHEAD
        return self.distinct * width <= (BROADCAST_BYTES if limit is None else limit)


def hot_share(spark: SparkSession) -> float:
    """The share of all rows from which a key is salted, given the number of shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(min(HOT_SHARE, 4 / partitions), LEAST_HOT_SHARE)


def join_back(
    df: DataFrame,
    table: DataFrame,
    key: str,
    profile: KeyProfile,
    salt_by: list[str],
    salts: int = SALTS,
) -> DataFrame:
    """Left-join a one-row-per-key ``table`` onto the rows of ``df``.

    Small tables are broadcast. Otherwise the rows of hot keys are spread over
    ``salts`` partitions, and only the hot keys' table rows are repeated to meet
    them. Null keys match nothing, so they are only spread.
    """
    if profile.fits_broadcast(len(table.columns)):
        return df.join(F.broadcast(table), key, "left")
    if not profile.hot and not profile.hot_null:
        return df.join(table, key, "left")
    spread = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    is_hot = F.col(key).isNull()
    copies = F.array(F.lit(0))
    if profile.hot:
        is_hot = is_hot | F.col(key).isin(*profile.hot)
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        copies = F.when(F.col(key).isin(*profile.hot), every).otherwise(copies)
    salted = df.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    repeated = table.withColumn("_salt", F.explode(copies))
    return salted.join(repeated, [key, "_salt"], "left").drop("_salt")


def sized(df: DataFrame, rows: int, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its counted rows stay below the size limit."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if rows * (row_bytes + _ROW_OVERHEAD) <= limit else df
