"""Thresholds, splits and flags on scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.quantile import exact_percentile

BUCKETS = 10_000


def _flag(df: DataFrame, out: str, hit: Column) -> DataFrame:
    """0 or 1; null where the score is null, since nothing was decided there."""
    return df.withColumn(out, hit.cast("int"))


def contamination_flag(df: DataFrame, score: str, contamination: float, out: str = "fraud_flag") -> DataFrame:
    """Flag scores strictly below the ``contamination`` quantile."""
    return _flag(df, out, F.col(score) < F.lit(exact_percentile(df, score, contamination)))


def percentile_flag(df: DataFrame, error: str, percentile: float, out: str = "fraud_flag") -> DataFrame:
    """Flag errors strictly above a percentile given from 0 to 100."""
    return _flag(df, out, F.col(error) > F.lit(exact_percentile(df, error, percentile / 100)))


def join_by_key(left: DataFrame, right: DataFrame, key_cols: list[str], how: str = "left") -> DataFrame:
    """Join on key columns, null keys meeting null keys; the keys stand once, from the left."""
    renamed = right.withColumnsRenamed({c: f"_key_{c}" for c in key_cols})
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key_cols]
    return left.join(renamed, same, how).drop(*[f"_key_{c}" for c in key_cols])


def attach_flags(
    source: DataFrame, flags: DataFrame, key_cols: list[str], only: str | None = None
) -> DataFrame:
    """Source rows with the flag and score columns of the same key, null user or not."""
    joined = join_by_key(source, flags, key_cols)
    return joined.filter(F.col(only) == 1) if only else joined


def hash_bucket(key_cols: list[str], seed: int) -> Column:
    """A bucket below ``BUCKETS`` from the md5 of seed and key, which any SQL engine can rebuild."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % BUCKETS


def split_train_test(
    df: DataFrame, key_cols: list[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A split by row key, the same under any partitioning."""
    is_test = hash_bucket(key_cols, seed) < int(test_share * BUCKETS)
    return df.filter(~is_test), df.filter(is_test)


def validation_split(df: DataFrame, key_cols: list[str], share: float = 0.2, seed: int = 43) -> DataFrame:
    """``df`` with a boolean ``is_validation``, drawn apart from the test split."""
    return df.withColumn("is_validation", hash_bucket(key_cols, seed) < int(share * BUCKETS))


def pseudo_label_f1(df: DataFrame, features: list[str], error: str, threshold: float) -> DataFrame:
    """F1 of ``error > threshold`` against a label made from the same rows.

    The label says whether the mean squared deviation from the rows' own means
    exceeds the threshold.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    spread = sum(
        ((F.col(c) - F.lit(means[c])) * (F.col(c) - F.lit(means[c])) for c in features[1:]),
        (F.col(features[0]) - F.lit(means[features[0]])) * (F.col(features[0]) - F.lit(means[features[0]])),
    ) / len(features)
    truth, guess = spread > threshold, F.col(error) > threshold
    counts = df.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    )
    base = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("f1", F.when(base > 0, 2.0 * F.col("tp") / base).otherwise(0.0))
