"""Day-by-day measures of a model's behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.quantile import grouped_percentiles


def drift_metrics(
    df: DataFrame, day: str, score: str, flag: str, features: list[str], accuracy: int | None = None
) -> DataFrame:
    """Rows, flagged rate, score quantiles and feature mean shifts per day.

    The quantiles are exact; ``accuracy`` switches to mergeable sketches, which
    need no sort.
    """
    base = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(flag).cast("long")).alias("flagged"),
        F.avg(F.col(flag).cast("double")).alias("flagged_rate"),
        *[(F.avg(c) - F.lit(base[c])).alias(f"{c}_shift") for c in features],
    ]
    if accuracy is not None:
        sketch = F.percentile_approx(score, [0.5, 0.99], accuracy)
        aggs += [sketch[0].alias("score_q50"), sketch[1].alias("score_q99")]
        return df.groupBy(day).agg(*aggs)
    quantiles = grouped_percentiles(df, day, score, {"score_q50": 0.5, "score_q99": 0.99})
    return df.groupBy(day).agg(*aggs).join(quantiles, day, "left")
