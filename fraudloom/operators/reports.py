"""Reports on flagged rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudloom.functions.text import email_domain_second
from fraudloom.operators.clean import _per_column
from fraudloom.operators.flags import join_by_key
from fraudloom.operators.group_features import FEATURES
from fraudloom.operators.key_tables import rows_where

# The four patterns, each a group measure and the limit it exceeds.
PATTERNS = {
    "multiple_cards_per_customer": ("cards_per_customer", 3),
    "multiple_addresses": ("addresses_per_card", 2),
    "high_frequency_cards": ("transactions_per_card", 10),
    "multiple_users_per_card": ("users_per_card", 1),
}

FLAGS = ["DBSCAN", "IsolationForest", "Autoencoder"]


def fraud_rate_summary(df: DataFrame, flag: str) -> DataFrame:
    counted = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("flagged_transactions"),
    )
    total = F.col("total_transactions")
    rate = F.when(total > 0, F.col("flagged_transactions") / total * 100)
    return counted.withColumn("fraud_rate", rate)


def suspicious_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n_rows) for each of the four patterns."""
    rules = {name: (FEATURES[feature], limit) for name, (feature, limit) in PATTERNS.items()}
    return rows_where(df, rules).withColumnRenamed("rule", "pattern")


def normal_vs_flagged(df: DataFrame, flag: str, features: list[str]) -> DataFrame:
    """Mean and sample deviation per feature, flagged rows against the rest."""
    hit = F.col(flag) == 1

    def of(fn, side: Column):
        return lambda c: fn(F.when(side, c.cast("double")))

    return _per_column(
        df,
        features,
        "feature",
        {
            "normal_mean": of(F.avg, ~hit),
            "normal_std": of(F.stddev_samp, ~hit),
            "fraud_mean": of(F.avg, hit),
            "fraud_std": of(F.stddev_samp, hit),
        },
    )


def _long(columns: list[str]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    )


def unusual_categories(df: DataFrame, flag: str, columns: list[str], factor: float = 2.0) -> DataFrame:
    """Values whose share among flagged rows exceeds ``factor`` times their normal share."""
    values = df.select(F.col(flag).alias("_flag"), _long(columns).alias("v")).select("_flag", "v.*")
    counts = (
        values.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count_if(F.col("_flag") == 1).alias("flagged"), F.count_if(F.col("_flag") != 1).alias("normal"))
    )
    totals = counts.groupBy("feature").agg(F.sum("flagged").alias("all_flagged"), F.sum("normal").alias("all_normal"))
    # totals has one row per listed column
    shares = counts.filter("flagged > 0").join(F.broadcast(totals), "feature")
    shares = shares.select(
        "feature",
        "value",
        (F.col("flagged") / F.col("all_flagged")).alias("flagged_share"),
        F.when(F.col("all_normal") > 0, F.col("normal") / F.col("all_normal")).otherwise(0.0).alias("normal_share"),
    )
    return shares.filter(F.col("flagged_share") > factor * F.col("normal_share"))


def deviation_scores(
    df: DataFrame, flag: str, features: list[str], detail: str = "Flagged by Isolation Forest"
) -> DataFrame:
    """Flagged rows with their distance from the normal mean, in normal deviations."""
    rest = df.filter(F.col(flag) != 1).agg(
        *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_samp(c).alias(f"s_{c}") for c in features]
    ).first()
    scores = {
        f"{c}_std_deviation": F.try_divide(
            F.abs(F.col(c) - F.lit(rest[f"m_{c}"])), F.lit(rest[f"s_{c}"]).cast("double")
        )
        for c in features
    }
    return df.filter(F.col(flag) == 1).withColumn("anomaly_details", F.lit(detail)).withColumns(scores)


def _flagged_by(flags: list[str]) -> Column:
    """One copy of a row per detector that flagged it."""
    hits = F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags])
    return F.explode(F.array_compact(hits)).alias("model")


def _every_model(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f,) for f in flags], "model string")


def model_summary(df: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """Rows, countries, states and e-mail domains flagged per detector."""
    counted = (
        df.select(_flagged_by(flags), "address_country", "address_state", email_domain_second("email").alias("domain"))
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_flagged"),
            F.count_distinct("address_country").alias("n_countries"),
            F.count_distinct("address_state").alias("n_states"),
            F.count_distinct("domain").alias("n_email_domains"),
        )
    )
    return _every_model(df, flags).join(counted, "model", "left").fillna(0)


def model_overlap(df: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """Rows flagged by both detectors of each pair, names in order."""
    pairs = list(combinations(sorted(flags), 2))
    both = [F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]
    rows = [
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"n{i}").alias("n_both"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*both).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_values(df: DataFrame, flags: list[str] = FLAGS, k: int = 5) -> DataFrame:
    """The ``k`` most frequent countries, states and domains per detector."""
    rows = df.select(
        _flagged_by(flags), "address_country", "address_state", email_domain_second("email").alias("email_domain")
    )
    values = rows.select("model", _long(["address_country", "address_state", "email_domain"]).alias("v"))
    counts = values.select("model", "v.*").filter("value IS NOT NULL").groupBy("model", "feature", "value").count()
    order = Window.partitionBy("model", "feature").orderBy(F.desc("n"), "value")
    ranked = counts.withColumnRenamed("count", "n").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def flagged_extract(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 1)


def combined_results(source: DataFrame, results: list[DataFrame], key_cols: list[str]) -> DataFrame:
    """All rows with every detector's flags and errors, joined by key, null user or not."""
    for result in results:
        source = join_by_key(source, result, key_cols)
    return source


def row_counts(df: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """All rows, and those that at least one detector could not decide."""
    undecided = F.greatest(*[F.col(f).isNull() for f in flags]) if len(flags) > 1 else F.col(flags[0]).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(undecided).alias("n_undecided"))
