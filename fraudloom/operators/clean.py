"""Filling, imputing, scaling and profiling of columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.quantile import grouped_percentiles

# Texts that stand for missing fields.
UNKNOWN_PLACE = "Unknown"
UNKNOWN_EMAIL = "unknown@unknown.com"
UNKNOWN_CATEGORY = "unknown"

COMPARISON_FILLS = {
    "address_country": UNKNOWN_PLACE,
    "address_state": UNKNOWN_PLACE,
    "email": UNKNOWN_EMAIL,
}


def fill_missing(df: DataFrame, fills: dict[str, str] | None = None) -> DataFrame:
    return df.fillna(COMPARISON_FILLS if fills is None else fills)


def fill_categories(df: DataFrame, columns: list[str], fill: str = UNKNOWN_CATEGORY) -> DataFrame:
    return df.fillna({c: fill for c in columns if c in df.columns})


def drop_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def select_features(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def _per_column(df: DataFrame, columns: list[str], name: str, metrics: dict) -> DataFrame:
    """One row per column from one aggregate: (name, metric, ...)."""
    aggs = [f(F.col(c)).alias(f"{m}_{i}") for i, c in enumerate(columns) for m, f in metrics.items()]
    row = F.array(
        *[
            F.struct(F.lit(c).alias(name), *[F.col(f"{m}_{i}").alias(m) for m in metrics])
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(row).alias("r")).select("r.*")


def profile_columns(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Count, nulls, mean, sample deviation, minimum, quartiles and maximum.

    The quartiles come from one distributed sort of the counted values, or with
    ``approx`` from mergeable sketches.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    metrics = {
        "n": lambda c: F.count(c),
        "n_null": lambda c: F.count_if(c.isNull()),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c),
        "max": lambda c: F.max(c),
    }
    if approx:
        metrics |= {k: lambda c, p=p: F.percentile_approx(c, p, 10_000) for k, p in quartiles.items()}
        return _per_column(numbers, columns, "column", metrics)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long = numbers.select(F.explode(pairs).alias("p")).select("p.*")
    return _per_column(numbers, columns, "column", metrics).join(
        grouped_percentiles(long, "column", "value", quartiles), "column", "left"
    )


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(
        df,
        columns,
        "feature",
        {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max},
    )


def fit_mean(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fit_most_frequent(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """The most frequent value of each column, the least on ties.

    Every column gets one, whether it has nulls here or not: rows scored later may
    lack what all training rows had. Values are counted by (column, value), so no
    task holds a column's values.
    """
    kinds: dict[str, list[str]] = {}
    types = dict(df.dtypes)
    for c in columns:
        kinds.setdefault("string" if types[c] == "string" else "double", []).append(c)
    out = {}
    for kind, names in kinds.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast(kind).alias("v")) for c in names])
        counts = df.select(F.explode(pairs).alias("p")).select("p.*").filter("v IS NOT NULL").groupBy("c", "v").count()
        best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("v"))
        out.update({r["c"]: r["v"] for r in best.collect()})
    return out


def impute(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.select(
        *[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c) for c in df.columns]
    )


@dataclass(frozen=True)
class Scale:
    mean: float
    std: float

    def apply(self, c: Column) -> Column:
        return (c - F.lit(self.mean)) / F.lit(self.std)


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, Scale]:
    """Mean and population deviation per column; a constant column scales to 0."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    row = df.agg(*aggs).first()
    out = {}
    for c in columns:
        mean, std = row[f"m_{c}"], row[f"s_{c}"]
        if mean is None:
            mean, std = 0.0, 1.0
        if std <= 1e-14 * max(1.0, abs(mean)):
            std = 1.0
        out[c] = Scale(float(mean), float(std))
    return out


def standardize(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.select(
        *[scales[c].apply(F.col(c)).alias(c) if c in scales else F.col(c) for c in df.columns]
    )
