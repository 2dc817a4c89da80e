"""Saving detectors and scoring rows with them, streamed or stored."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.operators import clean
from fraudloom.operators.feature_sets import SETS, FeatureModel, FeatureSet, fit
from fraudloom.operators.iforest import ForestModel, isolation_forest_fit, isolation_forest_score
from fraudloom.operators.key_tables import KeyTable, code_column
from fraudloom.operators.quantile import exact_percentile
from fraudloom.plans.sizing import KeyProfile
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage
from fraudloom.streaming.running import running_features


@dataclass(frozen=True)
class Detector:
    """A feature model, a forest on its features, and score thresholds."""

    features: FeatureModel
    forest: ForestModel
    flag_below: float
    watch_below: float

    def score(self, df: DataFrame, keep: list[str] | None = None, live: list[str] | None = None) -> DataFrame:
        """Row key, ``keep``, ``anomaly_score``, ``fraud_flag`` and ``risk_level``.

        Values that training did not have get the next free code and the counts'
        learned fills. A row that still lacks a feature has a null score, a null
        flag and the level ``unscored``. Works on streams: the lookup tables are
        static sides and the forest is broadcast, so no state is kept here. Counts
        that follow the stream come with its rows (``running_features``); ``live``
        names them.
        """
        rows = self.features.transform(df, keep, live)
        scored = isolation_forest_score(self.forest, rows, [*self.features.row_key, *(keep or [])])
        score = F.col("anomaly_score")
        level = (
            F.when(score.isNull(), "unscored")
            .when(score < self.flag_below, "high").when(score < self.watch_below, "medium").otherwise("low")
        )
        return scored.withColumn("fraud_flag", (score < self.flag_below).cast("int")).withColumn("risk_level", level)


def fit_detector(
    df: DataFrame, spec: FeatureSet, as_of: date, contamination: float = 0.01, watch: float = 0.05,
    n_estimators: int = 200, bootstrap: bool = True, seed: int = 42,
) -> Detector:
    model, raw = fit(df, spec, as_of)
    rows = cut_lineage(model.finish(raw))
    complete = clean.drop_incomplete(rows, model.features)
    forest = isolation_forest_fit(complete, model.features, n_estimators, "auto", bootstrap, seed, model.row_key)
    scored = cut_lineage(isolation_forest_score(forest, rows, model.row_key))
    return Detector(
        model, forest, exact_percentile(scored, "anomaly_score", contamination),
        exact_percentile(scored, "anomaly_score", watch),
    )


def retrain_on_window(
    df: DataFrame, ts: str, start: date, end: date, spec: FeatureSet, **settings
) -> Detector:
    """Fit on the rows of [start, end); the date filter reaches the scan."""
    window = df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    return fit_detector(window, spec, end, **settings)


def save_model(model: Detector, spark: SparkSession, path: str) -> str:
    """Publish a version: lookup tables and forest as parquet, parameters as one JSON row.

    Versions are never changed. The last thing written is a pointer row, so a
    reader sees the version before or the whole new one. Returns its name.
    """
    f = model.features
    header = {
        "spec": f.spec.name, "as_of": f.as_of.isoformat(), "row_key": f.row_key, "fills": f.fills, "unseen": f.unseen,
        "scales": {c: [s.mean, s.std] for c, s in f.scales.items()},
        "profiles": {
            k: {"distinct": t.profile.distinct, "max_bytes": t.profile.max_bytes,
                "hot": list(t.profile.hot), "hot_null": t.profile.hot_null}
            for k, t in f.tables.items()
        },
        "flag_below": model.flag_below, "watch_below": model.watch_below,
    }
    name = uuid.uuid4().hex
    version = f"{path}/versions/{name}"
    for key, table in f.tables.items():
        table.table.write.parquet(f"{version}/tables/{key}")
    model.forest.save(spark, f"{version}/forest")
    spark.createDataFrame([(json.dumps(header),)], "header string").coalesce(1).write.parquet(f"{version}/header")
    number = _published(spark, path)[0] + 1
    spark.createDataFrame([(number, name)], _POINTER).coalesce(1).write.mode("append").parquet(f"{path}/published")
    return name


_POINTER = "number long, version string"


def _published(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and name of the version published last; (0, None) before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return 0, None
    row = spark.read.schema(_POINTER).parquet(f"{path}/published").orderBy(F.desc("number"), F.desc("version")).first()
    return (row["number"], row["version"]) if row else (0, None)


def load_model(spark: SparkSession, path: str, version: str | None = None) -> Detector:
    """The version published last, or a named one."""
    version = version or _published(spark, path)[1]
    if version is None:
        raise FileNotFoundError(f"no model is published at {path}")
    path = f"{path}/versions/{version}"
    header = json.loads(spark.read.parquet(f"{path}/header").first()["header"])
    spec = SETS[header["spec"]]
    tables = {}
    for key, p in header["profiles"].items():
        profile = KeyProfile(p["distinct"], p["max_bytes"], tuple(p["hot"]), p["hot_null"])
        code = code_column(key) if key in spec.codes else None
        tables[key] = KeyTable(key, spark.read.parquet(f"{path}/tables/{key}"), profile, code)
    features = FeatureModel(
        spec, date.fromisoformat(header["as_of"]), tables, header["fills"],
        {c: clean.Scale(*s) for c, s in header["scales"].items()}, header["row_key"], header["unseen"],
    )
    forest = ForestModel.load(spark, f"{path}/forest")
    return Detector(features, forest, header["flag_below"], header["watch_below"])


def start_scoring(
    stream: DataFrame, model_path: str, out_path: str, checkpoint: str, keep: list[str] | None = None,
    available_now: bool = False, live: list[str] | None = None, order: list[str] | None = None,
    history: DataFrame | None = None,
):
    """Score every micro-batch with the version published at ``model_path`` at that time.

    With ``live`` features, each row is scored with its groups' counts as of its own
    arrival, in the order of ``order`` within a micro-batch and after ``history``;
    other counts are those of the model's tables.

    A batch is written to a folder named by the run, which its checkpoint folder
    stands for, and by its number. A replayed batch replaces its own folder, so
    each row lands once; another checkpoint writes beside it.
    """
    if live:
        stream = running_features(stream, live, order or list(KEY_COLS), history)
    folder = f"{out_path}/run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"

    def run(batch: DataFrame, number: int) -> None:
        model = load_model(batch.sparkSession, model_path)
        model.score(batch, keep, live).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def backfill_scores(df: DataFrame, model: Detector, path: str, day: str, keep: list[str] | None = None) -> None:
    """Score stored rows and replace exactly the days (or other periods) present in ``df``.

    Running a day again leaves the same files' worth of rows.
    """
    scored = model.score(df, [day, *(keep or [])])
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
