"""Parameter searches for the forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.iforest import ForestModel, isolation_forest_fit, isolation_forest_score
from fraudloom.operators.quantile import exact_percentiles
from fraudloom.operators.silhouette import silhouettes
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage

# The searched settings, in the order they are tried.
ESTIMATORS = [100, 200, 300]
CONTAMINATIONS = [0.01, 0.02, 0.03]
MAX_SAMPLES: list[int | str] = ["auto", 100, 200]


@dataclass(frozen=True)
class ForestSearch:
    runs: DataFrame
    best: dict | None
    model: ForestModel | None
    scored: DataFrame | None


def isolation_forest_search(
    df: DataFrame,
    features: list[str],
    estimators: list[int] = ESTIMATORS,
    contaminations: list[float] = CONTAMINATIONS,
    max_samples: list[int | str] = MAX_SAMPLES,
    metric: str = "squared",
    seed: int = 42,
    key_cols: list[str] | None = None,
) -> ForestSearch:
    """Best setting by the silhouette of flagged against unflagged rows.

    One forest per sample size is trained with the most trees; fewer trees are
    its prefixes and a contamination is only another threshold. All silhouettes
    are computed together. The first of equal scores wins, and a setting that
    leaves one label is skipped.
    """
    key_cols = key_cols or KEY_COLS
    df = df.select(*key_cols, *features).dropna(subset=features)
    n = df.count()
    models, scored = {}, df
    for j, size in enumerate(max_samples):
        models[j] = isolation_forest_fit(df, features, max(estimators), size, False, seed, key_cols, n)
        scored = isolation_forest_score(
            models[j], scored, scored.columns, prefixes={f"_s{j}_{k}": k for k in estimators}
        )
    scored = cut_lineage(scored)
    settings, labels = [], {}
    columns = [f"_s{j}_{k}" for j in models for k in estimators]
    cuts = exact_percentiles(scored, columns, contaminations)
    for k in estimators:
        for i, contamination in enumerate(contaminations):
            for j, size in enumerate(max_samples):
                name = f"_run{len(settings)}"
                labels[name] = (F.col(f"_s{j}_{k}") < F.lit(cuts[f"_s{j}_{k}"][i])).cast("int")
                settings.append((k, contamination, j, size, cuts[f"_s{j}_{k}"][i]))
    values = silhouettes(scored.select(*features, *[c.alias(n) for n, c in labels.items()]), features, list(labels), metric)
    counts = scored.agg(*[F.sum(c).alias(n) for n, c in labels.items()]).first()
    rows, best = [], None
    for i, (k, contamination, j, size, cut) in enumerate(settings):
        value = values[f"_run{i}"]
        rows.append((i, k, contamination, str(size), int(counts[f"_run{i}"] or 0), value))
        if value is not None and (best is None or value > best["silhouette"]):
            best = {
                "n_estimators": k, "contamination": contamination, "max_samples": size,
                "silhouette": value, "threshold": cut, "column": f"_s{j}_{k}", "forest": j,
            }
    schema = "run int, n_estimators int, contamination double, max_samples string, n_flagged long, silhouette double"
    runs = df.sparkSession.createDataFrame(rows, schema)
    if best is None:
        return ForestSearch(runs, None, None, None)
    flagged = scored.select(
        *key_cols,
        F.col(best["column"]).alias("anomaly_score"),
        (F.col(best["column"]) < best["threshold"]).cast("int").alias("IsolationForest"),
    )
    return ForestSearch(runs, best, models[best["forest"]].prefix(best["n_estimators"]), flagged)
