import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import clean, encode, feature_sets
from fraudloom.schemas import CARD, PRODUCT
from fraudloom.sources import readers, writers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_")).select(column).first()[0]


@pytest.mark.parametrize("email,second,last,guarded", [
    ("a@x.com", "x.com", "x.com", "x.com"), ("bad", None, "bad", "unknown"),
    ("a@b@c", "b", "c", "b"), (None, None, None, "unknown"),
])
def test_email_domains(spark, email, second, last, guarded):
    df = spark.createDataFrame([(email,)], "email string")
    row = df.select(
        text.email_domain_second("email"), text.email_domain_last("email"), text.email_domain_guarded("email")
    ).first()
    assert tuple(row) == (second, last, guarded)


@pytest.mark.parametrize("value,number", [
    ("08", 8.0), (" 7 ", 7.0), ("xx", 1.0), (None, 1.0), ("8d", 1.0), ("nan", 1.0), ("1e1", 10.0), ("", 1.0),
])
def test_to_number(spark, value, number):
    df = spark.createDataFrame([(value,)], "c string")
    assert df.select(text.to_number("c", 1)).first()[0] == number


def test_minor_units_truncates(spark):
    df = spark.createDataFrame([("19.99",)], "a string")
    assert tuple(df.select(text.minor_units("a"), text.minor_units("a", exact=True)).first()) == (1998, 1999)


def test_last4_of_a_short_number(spark):
    df = spark.createDataFrame([("378282246310005",)], "n string")
    assert tuple(df.select(text.last4("n"), text.last4("n", "right")).first()) == ("005", "0005")


def test_display_date(spark):
    df = spark.createDataFrame([("2021-02-12T00:00",), ("2021-13-12",)], "d string")
    assert [r[0] for r in df.select(text.display_date("d")).collect()] == ["12 Feburary 2021", None]


def test_feature_set_edges(spark, cards):
    df = cards
    raw = feature_sets.fit_tables(df, feature_sets.COMPARISON12, date(2024, 6, 15)).raw(df).orderBy("id").collect()
    assert [r["card_usage_count"] for r in raw] == [3, 3, 3, None, None, 1]
    assert [r["multiple_states"] for r in raw] == [1, 1, 1, 0, 0, 0]
    assert raw[2]["email_domain"] is None and raw[3]["email_domain_freq"] == 1
    assert raw[2]["exp_month"] == 1 and raw[2]["exp_year"] == 2024
    model, raw = feature_sets.fit(df, feature_sets.FOREST, date(2024, 6, 15))
    done = model.finish(raw).toPandas()
    assert not done.isna().any().any()
    assert abs(done[model.features].mean()).max() < 1e-9


def test_empty_and_constant(spark, cards):
    empty = cards.limit(0)
    model, raw = feature_sets.fit(empty, feature_sets.COMPARISON10, date(2024, 6, 15))
    assert model.finish(raw).count() == 0
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, x double")
    scaled = clean.standardize(same, clean.fit_scale(same, ["x"]))
    assert [r["x"] for r in scaled.collect()] == [0.0, 0.0]


def test_codes_follow_binary_order_and_report_unseen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (4, "é")], "id long, c string")
    model = encode.fit_codes(df, ["c"])
    codes = {r["id"]: r["c"] for r in encode.apply_codes(df, model, ["c"], ["id"]).collect()}
    assert codes == {2: 0, 1: 1, 4: 2, 3: None}
    new = spark.createDataFrame([(9, "zz")], "id long, c string")
    assert encode.apply_codes(new, model, ["c"], ["id"], "keep").first()["c"] == 3
    with pytest.raises(Exception, match="unseen value"):
        encode.apply_codes(new, model, ["c"], ["id"]).collect()


def test_csv_keeps_leading_zeros(spark, cards, tmp_path):
    path = str(tmp_path / "cards")
    writers.write_report(cards.select(*CARD.fieldNames()), path, "csv")
    back = readers.read_csv(spark, path, CARD)
    assert {r["exp_month"] for r in back.collect()} == {"08", "8", "xx", None, "12", "1"}
    with pytest.raises(ValueError):
        writers.write_report(cards, path, "xls")


def test_tables_and_dump(spark, cards, tmp_path):
    cards.createOrReplaceTempView("known_cards")
    readers.require_table(spark, "known_cards")
    with pytest.raises(ValueError):
        readers.require_table(spark, "absent_cards")
    described = readers.describe_table(spark, "known_cards").orderBy("position").collect()
    assert described[0]["column_name"] == "id" and described[0]["column_type"] == "bigint"
    path = tmp_path / "dump.json"
    path.write_text(json.dumps([
        {"model": "product.product", "pk": 7, "fields": {"name": "Watch", "price": "399.99", "stock": True}},
        {"model": "account.card", "pk": 1, "fields": {"card_number": "0042", "user": 3}},
        {"model": "auth.permission", "pk": 1, "fields": {}},
    ], indent=4))
    tables = readers.read_model_dump(
        spark, str(path), {"product.product": PRODUCT, "account.card": CARD, "auth.permission": CARD}
    )
    assert set(tables) == {"product.product", "account.card"}
    assert float(tables["product.product"].first()["price"]) == 399.99
    card = tables["account.card"].first()
    assert (card["card_number"], card["user_id"]) == ("0042", 3)
