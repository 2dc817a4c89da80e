import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.operators.group_features import FEATURES, add_group_features, fit_group_features
from fraudloom.operators.key_tables import fit_key_tables
from fraudloom.operators.numbering import number_rows
from fraudloom.operators.quantile import exact_percentiles, grouped_percentiles
from fraudloom.plans import sizing


def test_null_keys_stay_null(cards):
    df = add_group_features(cards, ["transactions_per_card", "users_per_card", "cards_per_user"])
    rows = {r["id"]: r for r in df.collect()}
    assert rows[1]["transactions_per_card"] == 3 and rows[1]["users_per_card"] == 2
    assert rows[4]["transactions_per_card"] is None and rows[4]["cards_per_user"] == 0


def test_fill_before_group_counts_the_missing(cards):
    fills = {"address_state": "Unknown", "address_country": "Unknown"}
    plain = add_group_features(cards, ["transactions_per_state"])
    filled = add_group_features(cards, ["transactions_per_state", "multiple_states"], fills)
    assert plain.filter("id = 3").first()["transactions_per_state"] is None
    assert filled.filter("id = 3").first()["transactions_per_state"] == 1
    assert filled.filter("id = 1").first()["multiple_states"] is True


def test_approx_counts_agree_on_small_groups(cards):
    exact = add_group_features(cards, ["users_per_card"]).orderBy("id").collect()
    approx = add_group_features(cards, ["users_per_card"], approx=True).orderBy("id").collect()
    assert [r["users_per_card"] for r in exact] == [r["users_per_card"] for r in approx]


def test_hot_keys_are_salted_and_results_whole(spark, monkeypatch):
    # a third of the rows on one card, another third without a card
    rows = spark.range(6000).select(
        "id", (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("c"), F.col("id"))).alias("card_number"),
    )
    names = ["transactions_per_card", "users_per_card"]
    tables = fit_key_tables(rows, [FEATURES[n] for n in names], salt_from_rows=1)
    profile = tables["card_number"].profile
    assert profile.hot == ("hot",) and profile.hot_null
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    df = add_group_features(rows, names, tables=tables)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    got = {r["id"]: (r["transactions_per_card"], r["users_per_card"]) for r in df.collect()}
    assert len(got) == 6000
    assert got[0] == (2000, 7) and got[1] == (1, 1) and got[2] == (None, None)


def test_small_tables_are_broadcast(cards):
    df = add_group_features(cards, ["transactions_per_state"], tables=fit_group_features(cards, ["transactions_per_state"]))
    assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exact_rows", [10, 1_000_000])
def test_exact_percentiles(spark, exact_rows):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=30_000), np.full(15_000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    ps = [0.0, 0.013, 0.5, 0.98, 1.0]
    got = exact_percentiles(df, ["x"], ps, exact_rows)["x"]
    assert np.allclose(got, np.percentile(x, [100 * p for p in ps]), rtol=0, atol=1e-12)


def test_percentile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_percentiles(df, ["x"], [0.5]) == {"x": [None]}


def test_grouped_percentiles_of_a_large_group(spark):
    rng = np.random.default_rng(1)
    rows = [("big", float(round(v, 2))) for v in rng.normal(size=5000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in grouped_percentiles(df, "g", "v", {"a": 0.25, "b": 0.9}).collect()}
    big = [v for g, v in rows if g == "big"]
    assert np.allclose(got["big"], np.percentile(big, [25, 90]), atol=1e-12)
    assert got["one"] == (3.0, 3.0) and np.allclose(got["two"], (1.25, 1.9))


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(9)
    assert [r["n"] for r in number_rows(df, ["k"], "n").orderBy("k").collect()] == list(range(1000))
