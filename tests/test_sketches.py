"""Windows merged from daily sketches against counts over the window's rows."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudloom.operators import sketches
from fraudloom.operators.group_features import add_group_features

NAMES = ["transactions_per_card", "users_per_card", "multiple_states"]
START, DAYS = date(2024, 1, 1), 120


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 60_000
    made = [
        (i, int(rng.integers(0, 20_000)), None if i % 50 == 0 else f"card{int(rng.exponential(20))}", f"cus{i % 900}",
         [None, "MH", "KA"][i // 900 % 3] if i % 900 < 300 else "MH", START + timedelta(days=int(rng.integers(0, DAYS))))
        for i in range(n)
    ]
    return spark.createDataFrame(made, "id long, user_id long, card_number string, customer_id string, address_state string, day date").repartition(4).cache()


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sketches") / "days")
    first = F.col("day") < F.lit(START + timedelta(days=100))
    sketches.store_days(rows.filter(first), "day", NAMES, path)
    sketches.store_days(rows.filter(~first), "day", NAMES, path)  # later days come later
    return path


def test_a_window_of_ninety_days(spark, rows, stored):
    start, end = START + timedelta(days=17), START + timedelta(days=107)
    inside = rows.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))
    exact = add_group_features(inside, NAMES)
    counts = sketches.window_counts(spark.read.parquet(stored), start, end, NAMES)
    cards = counts["card_number"]
    want = exact.filter("card_number IS NOT NULL").select("card_number", *NAMES[:2]).distinct()
    both = want.select("card_number", F.col("transactions_per_card").alias("n")).join(cards, "card_number")
    assert both.filter("n <> transactions_per_card").count() == 0 and both.count() == want.count() == cards.count()
    far = sketches.relative_errors(want, cards, "card_number", "users_per_card").agg(
        F.max("exact"), F.max("error"), F.sqrt(F.avg(F.col("error") * F.col("error"))), F.max(F.when(F.col("exact") < 30, F.col("error")))
    ).first()
    assert far[0] > 1000 and far[1] < 4 * 0.0163 and far[2] < 0.0163 and far[3] == 0  # 1.04 / sqrt(2 ** 12)
    states = {r["customer_id"]: r["multiple_states"] for r in counts["customer_id"].collect()}
    assert states == {r[0]: r[1] for r in exact.filter("customer_id IS NOT NULL").select("customer_id", "multiple_states").distinct().collect()}
    assert set(states.values()) == {True, False}


def test_a_day_is_replaced_not_added(spark, rows, stored):
    day = START + timedelta(days=3)
    before = spark.read.parquet(stored).filter(F.col("day") == F.lit(day)).agg(F.sum("n_id")).first()[0]
    sketches.store_days(rows.filter(F.col("day") == F.lit(day)), "day", NAMES, stored)
    read = spark.read.parquet(stored)
    assert read.filter(F.col("day") == F.lit(day)).agg(F.sum("n_id")).first()[0] == before
    assert read.select("day").distinct().count() == DAYS


def test_rows_get_their_groups_counts(spark, rows, stored):
    start, end = START + timedelta(days=50), START + timedelta(days=52)
    got = sketches.add_window_counts(rows, spark.read.parquet(stored), start, end, ["transactions_per_card"])
    assert got.count() == rows.count()
    assert got.filter("card_number IS NULL AND transactions_per_card IS NOT NULL").count() == 0
    inside = rows.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end))).groupBy("card_number").count()
    want = {r[0]: r[1] for r in inside.filter("card_number IS NOT NULL").collect()}
    assert {r[0]: r[1] for r in got.filter("transactions_per_card IS NOT NULL").select("card_number", "transactions_per_card").distinct().collect()} == want
    nothing = sketches.add_window_counts(rows, spark.read.parquet(stored), date(2030, 1, 1), date(2030, 2, 1), NAMES)
    assert nothing.filter(" OR ".join(f"{c} IS NOT NULL" for c in NAMES)).count() == 0
