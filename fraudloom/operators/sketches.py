"""Group counts over moving windows from mergeable daily sketches.

A day's rows are folded once into one row per key value: row counts, and a HyperLogLog
sketch of the members for each distinct count. A window of any length is then a merge of
its days' rows; no transaction is read again, and what is kept does not grow with the
rows of a day but with its key values. Counts are exact. Distinct counts are estimates:
with ``LG_K`` = 12 their standard error is 1.6 %, and counts of a few dozen members are
in effect exact, as a sketch keeps those as they are.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.group_features import FEATURES
from fraudloom.operators.key_tables import Measure
from fraudloom.plans.sizing import KeyProfile, hot_share, join_back
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage

LG_K = 12


def _by_key(names: Iterable[str | Measure]) -> dict[str, list[Measure]]:
    found: dict[str, list[Measure]] = {}
    for m in (FEATURES[n] if isinstance(n, str) else n for n in names):
        found.setdefault(m.key, []).append(m)
    return found


def _column(m: Measure) -> str:
    return f"{'n' if m.fn == 'count' else 's'}_{m.value}"


def day_sketches(df: DataFrame, day: str, names: Iterable[str | Measure]) -> DataFrame:
    """(day, key, value, n_*, s_*): one row per day and key value, for all keys from one scan.

    Rows without a day or a key value count nowhere. ``df`` is exploded to one narrow
    record per key, and members are sketched before the shuffle.
    """
    groups = _by_key(names)
    counted = sorted({m.value for ms in groups.values() for m in ms if m.fn == "count"})
    sketched = sorted({m.value for ms in groups.values() for m in ms if m.fn != "count"})
    records = F.array(*[
        F.struct(
            F.lit(key).alias("key"), F.col(key).cast("string").alias("value"),
            *[F.when(F.lit(any(m.fn == "count" and m.value == c for m in ms)), F.col(c).isNotNull().cast("long")).alias(f"n_{c}") for c in counted],
            *[F.when(F.lit(any(m.fn != "count" and m.value == c for m in ms)), F.col(c).cast("string")).alias(f"s_{c}") for c in sketched],
        )
        for key, ms in groups.items()
    ])
    long = df.select(F.col(day).cast("date").alias("day"), F.explode(records).alias("r")).select("day", "r.*")
    return long.filter("day IS NOT NULL AND value IS NOT NULL").groupBy("day", "key", "value").agg(
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in counted],
        *[F.hll_sketch_agg(f"s_{c}", LG_K).alias(f"s_{c}") for c in sketched],
    )


def store_days(df: DataFrame, day: str, names: Iterable[str | Measure], path: str, files: int = 1) -> None:
    """Write the sketches of the days present in ``df``, replacing exactly those days; ``files`` of them per day."""
    # rows of a day leave from few tasks, so that a day is a few files whatever the cluster
    made = day_sketches(df, day, names).withColumn("deal", F.pmod(F.xxhash64("key", "value"), F.lit(files))).repartition("day", "deal").drop("deal")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def window_counts(stored: DataFrame, start, end, names: Iterable[str | Measure]) -> dict[str, DataFrame]:
    """(key, measures) per key from the stored days of [start, end); the day filter prunes folders."""
    inside = stored.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    out = {}
    for key, measures in _by_key(names).items():
        rows = inside.filter(F.col("key") == key)
        merged = rows.groupBy(F.col("value").alias(key)).agg(*[_merged(m).alias(m.out) for m in measures])
        out[key] = merged
    return out


def _merged(m: Measure) -> Column:
    if m.fn == "count":
        return F.coalesce(F.sum(_column(m)), F.lit(0))
    n = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(_column(m))), F.lit(0))
    return n > 1 if m.fn == "many" else n


def add_window_counts(
    df: DataFrame, stored: DataFrame, start, end, names: Iterable[str | Measure], row_key: list[str] | None = None
) -> DataFrame:
    """``df`` with the window's measures of each row's groups; null without a key, or where the window has no such value.

    The added columns can be given to a detector as the counts that rows carry (``live``).
    """
    spark = df.sparkSession
    for key, counts in window_counts(stored, start, end, names).items():
        table = cut_lineage(counts)
        size = F.greatest(*[F.col(c).cast("long") for c in table.columns if c != key], F.lit(0))
        count, total, width = table.agg(F.count(F.lit(1)), F.sum(size), F.max(F.octet_length(key))).first()
        floor = max(int((total or 0) * hot_share(spark)), 1000)
        typed = table.withColumn(key, F.col(key).cast(df.schema[key].dataType))
        hot = tuple(r[key] for r in typed.filter(size >= floor).select(key).collect())
        df = join_back(df, typed, key, KeyProfile(count, width or 0, hot), row_key or KEY_COLS)
    return df


def relative_errors(exact: DataFrame, estimated: DataFrame, key: str, out: str) -> DataFrame:
    """(key, exact, estimated, error): how far estimates lie off, as a share of the exact count."""
    both = exact.select(key, F.col(out).alias("exact")).join(estimated.select(key, F.col(out).alias("estimated")), key)
    return both.withColumn("error", F.abs(F.col("estimated") - F.col("exact")) / F.greatest("exact", F.lit(1)))

