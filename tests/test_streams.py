import time
import uuid
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fraudloom.operators import feature_sets
from fraudloom.plans import compare
from fraudloom.operators.autoencoder import Network
from fraudloom.sources import fixtures as fx
from fraudloom.streaming import scoring, velocity

AS_OF = date(2024, 6, 15)


def run(df, mode="append"):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream_of(spark, sf_dir, table):
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@pytest.mark.parametrize("kind", ["velocity", "daily_summary"])
def test_stream_equals_batch(spark, sf_dir, kind):
    fn = getattr(velocity, kind)
    stream = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(fn(stream), "complete")
    want = fn(fx.events(spark, sf_dir))
    key = [c for c in want.columns if c != "total"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    # the watermark of one batch judges the rows of the next but one
    schema = "ts timestamp, user_id long"
    for i, hour in enumerate([1, 9, 10, 1, 14]):
        day = datetime(2024, 1, 1, hour)
        spark.createDataFrame([(day, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i < 4:
            time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(velocity.velocity(stream, length="1 hour", slide=None, watermark="1 hour"))
    rows = {r["window_start"].hour: r["n"] for r in got.collect()}
    assert rows[1] == 1 and rows[9] == 1


def test_alerts_once_per_key(spark, sf_dir):
    stream = stream_of(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(velocity.alerts(stream.unionByName(stream), ["event_id"], "ts", "value", 50.0))
    want = fx.events(spark, sf_dir).filter("value > 50").select("event_id").distinct()
    assert got.count() == want.count() > 0


@pytest.fixture(scope="module")
def detector(spark, sf_dir):
    return scoring.fit_detector(fx.transactions(spark, sf_dir), feature_sets.FOREST, AS_OF, n_estimators=30)


def scores(df):
    return {(r["id"], r["user_id"]): (round(r["anomaly_score"], 9), r["risk_level"]) for r in df.collect()}


def test_saved_model_scores_a_stream_like_a_table(spark, sf_dir, detector, tmp_path):
    model, stored = str(tmp_path / "model"), str(tmp_path / "cards")
    scoring.save_model(detector, spark, model)
    cards = fx.transactions(spark, sf_dir)
    cards.repartition(3).write.parquet(stored)
    want = scores(detector.score(cards))
    assert scores(scoring.load_model(spark, model).score(cards)) == want
    stream = spark.readStream.schema(cards.schema).option("maxFilesPerTrigger", 1).parquet(stored)
    assert scores(run(detector.score(stream))) == want
    q = scoring.start_scoring(stream, model, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    assert q.awaitTermination(180)
    assert scores(spark.read.parquet(str(tmp_path / "out"))) == want
    share = sum(level == "high" for _, level in want.values()) / len(want)
    assert 0 < share <= 0.011


def test_backfill_twice_leaves_the_same_rows(spark, sf_dir, detector, tmp_path):
    cards = fx.transactions(spark, sf_dir).withColumn("day", F.lit(date(2024, 1, 1)))
    other = cards.withColumn("day", F.lit(date(2024, 1, 2)))
    path = str(tmp_path / "scores")
    for part in (cards, other, other):
        scoring.backfill_scores(part, detector, path, "day")
    days = {r["day"]: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()}
    assert days == {date(2024, 1, 1): cards.count(), date(2024, 1, 2): cards.count()}


def test_retrain_on_window(spark, sf_dir):
    cards = fx.transactions(spark, sf_dir).join(
        fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS day"), "id"
    )
    model = scoring.retrain_on_window(
        cards, "day", date(1995, 1, 1), date(1997, 1, 1), feature_sets.CLUSTER, n_estimators=10
    )
    assert model.forest.n_trees == 10 and model.features.as_of == date(1997, 1, 1)


def test_whole_jobs(spark, sf_dir, tmp_path):
    cards = fx.transactions(spark, sf_dir)
    quick = Network(hidden=(6, 3, 6), epochs=2)
    searched = compare.compare_on_search(
        cards, AS_OF, quick, estimators=[10], contaminations=[0.02], max_samples=["auto", 50]
    )
    assert searched.frames["model_overlap"].count() == 3 and searched.frames["feature_stats"].count() == 12
    searched.write(str(tmp_path / "report"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "report" / "autoencoder_anomalies"))
    assert "Autoencoder_Error" in back.columns and back.count() > 0
    report = compare.forest_report(cards, AS_OF, n_estimators=20)
    total = report.frames["summary"].first()
    assert total["total_transactions"] == cards.count()
    assert report.frames["flagged_with_analysis"].count() == total["flagged_transactions"] > 0
    assert compare.autoencoder_report(cards, AS_OF, Network(hidden=(4,), epochs=2)).frames["metrics"].count() == 1


def test_compare_on_dbscan_search(spark, sf_dir):
    report = compare.compare_on_dbscan_search(
        fx.transactions(spark, sf_dir), AS_OF, Network(hidden=(6, 3, 6), epochs=1), n_estimators=10
    )
    assert report.frames["search_runs"].count() == 9
    assert {r["model"] for r in report.frames["model_summary"].collect()} == {"DBSCAN", "IsolationForest", "Autoencoder"}
    assert compare.cluster_report(fx.transactions(spark, sf_dir), AS_OF).frames["summary"].count() == 1


def test_unseen_values_are_scored_or_said_to_be_unscored(spark, sf_dir, detector):
    cards = fx.transactions(spark, sf_dir).limit(50).cache()
    new = cards.withColumn("card_number", F.concat(F.lit("9"), F.col("id"))).withColumn("address_city", F.lit("New City"))
    rows = detector.score(new).collect()
    assert len(rows) == 50 and all(r["anomaly_score"] is not None for r in rows)
    bare = scoring.fit_detector(fx.transactions(spark, sf_dir), feature_sets.CLUSTER, AS_OF, n_estimators=10)
    got = bare.score(new).collect()  # this set learns no fills, so a new card has no counts
    assert {(r["fraud_flag"], r["risk_level"]) for r in got} == {(None, "unscored")}
    strict = feature_sets.FeatureModel(**{**detector.features.__dict__, "unseen": "error"})
    with pytest.raises(Exception, match="unseen value in address_city"):
        strict.transform(new.withColumn("card_number", F.lit(None).cast("string"))).collect()


def test_republished_model_scores_the_next_batch(spark, sf_dir, detector, tmp_path):
    model, stored, out, ck = (str(tmp_path / n) for n in ("model", "cards", "out", "ck"))
    cards = fx.transactions(spark, sf_dir).limit(40)
    scoring.save_model(detector, spark, model)
    first = scoring.load_model(spark, model)
    cards.coalesce(1).write.mode("append").parquet(stored)
    stream = spark.readStream.schema(cards.schema).parquet(stored)
    assert scoring.start_scoring(stream, model, out, ck, available_now=True).awaitTermination(180)
    scoring.save_model(scoring.Detector(first.features, first.forest, 1.0, 1.0), spark, model)
    cards.coalesce(1).write.mode("append").parquet(stored)
    assert scoring.start_scoring(stream, model, out, ck, available_now=True).awaitTermination(180)
    by_batch = {r["batch"]: r["n"] for r in spark.read.parquet(out).filter("fraud_flag = 1").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert by_batch[1] == 40 and by_batch.get(0, 0) < 40
    other = scoring.start_scoring(stream, model, out, str(tmp_path / "ck2"), available_now=True)
    assert other.awaitTermination(180)
    assert spark.read.parquet(out).select("run").distinct().count() == 2


def test_settled_keeps_the_result_alone(spark):
    import os

    from fraudloom.session import cut_lineage, owned_tables, settled

    with owned_tables(spark) as folder:
        made = settled(spark, lambda: cut_lineage(spark.range(9).groupBy("id").count()).filter("id > 3"))
        assert made.count() == 5
        assert len(os.listdir(folder.removeprefix("file:"))) == 1


def test_owned_tables_are_deleted(spark, tmp_path):
    import os

    from fraudloom.session import cut_lineage, owned_tables

    with owned_tables(spark) as folder:
        assert cut_lineage(spark.range(5)).count() == 5
        local = folder.removeprefix("file:")
        assert os.listdir(local)
    assert not os.path.exists(local)
