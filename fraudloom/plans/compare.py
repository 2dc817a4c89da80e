"""The whole jobs: three-model comparison, forest report, cluster report.

Each returns its frames; ``write_report`` stores them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import autoencoder as ae
from fraudloom.operators import clean, dbscan, feature_sets, flags, reports
from fraudloom.operators.group_features import add_group_features
from fraudloom.operators.iforest import isolation_forest_fit, isolation_forest_score
from fraudloom.operators.quantile import exact_percentile
from fraudloom.operators.search import CONTAMINATIONS, ESTIMATORS, MAX_SAMPLES, isolation_forest_search
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage
from fraudloom.sources.writers import write_report

FOREST_FEATURES = [
    "transactions_per_card", "transactions_per_customer", "transactions_per_state", "transactions_per_zip",
    "email_domain_freq", "cards_per_customer", "addresses_per_card", "users_per_card", "cards_per_user",
]


@dataclass
class Report:
    """Named result frames of a job."""

    frames: dict[str, DataFrame] = field(default_factory=dict)
    settings: dict = field(default_factory=dict)

    def write(self, path: str, fmt: str = "parquet") -> None:
        for name, frame in self.frames.items():
            write_report(frame, f"{path}/{name}", fmt)


def _comparison(source: DataFrame, found: list[DataFrame], stats: DataFrame, runs: DataFrame, settings: dict) -> Report:
    """Every source row stays; rows that a detector could not take have a null flag there."""
    combined = cut_lineage(reports.combined_results(source, found, KEY_COLS))
    frames = {
        "feature_stats": stats, "search_runs": runs, "all_model_results": combined,
        "row_counts": reports.row_counts(combined),
        "model_summary": reports.model_summary(combined), "model_overlap": reports.model_overlap(combined),
        "top_values": reports.top_values(combined),
    }
    for flag in reports.FLAGS:
        frames[f"{flag.lower()}_anomalies"] = reports.flagged_extract(combined, flag)
    return Report(frames, settings)


def _prepared(source: DataFrame, spec: feature_sets.FeatureSet, as_of: date) -> tuple[DataFrame, list[str]]:
    model, raw = feature_sets.fit(source, spec, as_of)
    return cut_lineage(clean.drop_incomplete(model.finish(raw), model.features)), model.features


def compare_on_search(
    source: DataFrame, as_of: date, network: ae.Network = ae.REGULARISED, percentile: float = 98,
    eps: float = 0.5, min_samples: int = 3, estimators=ESTIMATORS, contaminations=CONTAMINATIONS,
    max_samples=MAX_SAMPLES, metric: str = "squared", seed: int = 42,
) -> Report:
    """12 features, a searched forest, a regularised autoencoder, fixed DBSCAN."""
    rows, names = _prepared(source, feature_sets.COMPARISON12, as_of)
    found = isolation_forest_search(rows, names, estimators, contaminations, max_samples, metric, seed)
    model = ae.autoencoder_fit(rows, names, network, seed)
    errors = flags.percentile_flag(
        cut_lineage(ae.autoencoder_error(model, rows)), "Autoencoder_Error", percentile, "Autoencoder"
    )
    noise = dbscan.dbscan_noise(rows, names, eps, min_samples)
    forest = found.scored.select(*KEY_COLS, "IsolationForest")
    return _comparison(
        source, [noise, forest, errors], clean.feature_stats(rows, names), found.runs,
        {"forest": found.best, "dbscan": (eps, min_samples)},
    )


def compare_on_dbscan_search(
    source: DataFrame, as_of: date, network: ae.Network = ae.PLAIN, percentile: float = 99,
    contamination: float = 0.01, n_estimators: int = 100, target_outliers: int = dbscan.TARGET_OUTLIERS, seed: int = 42,
) -> Report:
    """10 features, a searched DBSCAN, a default forest, a plain autoencoder."""
    rows, names = _prepared(source, feature_sets.COMPARISON10, as_of)
    searched = dbscan.dbscan_search(rows, names, target_outliers=target_outliers)
    noise = dbscan.noise_rows(rows, names, searched.run, searched.setting)
    forest = isolation_forest_fit(rows, names, n_estimators, "auto", False, seed)
    scored = cut_lineage(isolation_forest_score(forest, rows))
    scored = flags.contamination_flag(scored, "anomaly_score", contamination, "IsolationForest")
    model = ae.autoencoder_fit(rows, names, network, seed)
    errors = cut_lineage(ae.autoencoder_error(model, rows))
    errors = flags.percentile_flag(errors, "Autoencoder_Error", percentile, "Autoencoder")
    return _comparison(
        source, [noise, scored.select(*KEY_COLS, "IsolationForest"), errors.select(*KEY_COLS, "Autoencoder")],
        clean.feature_stats(rows, names), searched.runs, {"dbscan": searched.best},
    )


def forest_report(
    source: DataFrame, as_of: date, contamination: float = 0.01, n_estimators: int = 200, seed: int = 42
) -> Report:
    """Fit, flag, count suspicious patterns and explain the flagged rows."""
    rows, names = _prepared(source, feature_sets.FOREST, as_of)
    forest = isolation_forest_fit(rows, names, n_estimators, "auto", True, seed)
    scored = cut_lineage(isolation_forest_score(forest, rows))
    scored = flags.contamination_flag(scored, "anomaly_score", contamination)
    measured = add_group_features(
        source.withColumn("email_domain", text.email_domain_guarded("email")), FOREST_FEATURES
    )
    expiry = text.card_expiry_months(
        text.to_number("exp_month", 1), text.to_number("exp_year", as_of.year), as_of.year
    )
    flagged = cut_lineage(
        flags.attach_flags(measured.withColumn("card_expiry_months", expiry).drop("email_domain"), scored, KEY_COLS)
    )
    shown = [*FOREST_FEATURES, "card_expiry_months"]
    return Report(
        {
            "summary": reports.fraud_rate_summary(flagged, "fraud_flag"),
            "suspicious_patterns": reports.suspicious_patterns(source),
            "normal_vs_flagged": reports.normal_vs_flagged(flagged, "fraud_flag", shown),
            "unusual_categories": reports.unusual_categories(
                flagged, "fraud_flag", ["address_state", "address_city", "address_country"]
            ),
            "flagged_with_analysis": reports.deviation_scores(flagged, "fraud_flag", shown),
        }
    )


def autoencoder_report(
    source: DataFrame, as_of: date, network: ae.Network = ae.STANDALONE, percentile: float = 95, seed: int = 42
) -> Report:
    """Train on 80%, take the threshold from the other 20%, flag every row."""
    model, raw = feature_sets.fit(source, feature_sets.AUTOENCODER, as_of)
    rows = cut_lineage(model.finish(raw))
    train, test = flags.split_train_test(rows, KEY_COLS, 0.2, seed)
    net = ae.autoencoder_fit(train, model.features, network, seed)
    tested = cut_lineage(ae.autoencoder_error(net, test, [*KEY_COLS, *model.features], "error"))
    threshold = exact_percentile(tested, "error", percentile / 100)
    f1 = flags.pseudo_label_f1(tested, model.features, "error", threshold)
    errors = cut_lineage(ae.autoencoder_error(net, rows, out="anomaly_score"))
    errors = errors.withColumn("fraud_flag", (F.col("anomaly_score") > threshold).cast("int"))
    flagged = flags.attach_flags(source, errors, KEY_COLS)
    return Report(
        {
            "summary": reports.fraud_rate_summary(flagged, "fraud_flag"),
            "metrics": ae.training_metrics(net, f1.first()["f1"], threshold, source.sparkSession),
            "f1": f1,
            "fraudulent_transactions": reports.flagged_extract(flagged, "fraud_flag"),
        }
    )


def cluster_report(source: DataFrame, as_of: date, eps: float = 0.5, min_samples: int = 5) -> Report:
    rows, names = _prepared(source, feature_sets.CLUSTER, as_of)
    noise = dbscan.dbscan_noise(rows, names, eps, min_samples, out="is_anomaly")
    flagged = cut_lineage(flags.attach_flags(source, noise, KEY_COLS))
    return Report(
        {
            "summary": reports.fraud_rate_summary(flagged, "is_anomaly"),
            "row_counts": reports.row_counts(flagged, ["is_anomaly"]),
            "all_rows": flagged,
        }
    )
