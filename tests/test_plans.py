"""Shapes of the physical plans."""

import pytest

import __spark_entry__ as entry
from fraudloom.sources import fixtures as fx
from fraudloom.operators import reports

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
CHECKED = [
    "transactions_per_card", "features_forest", "suspicious_patterns", "top_values", "unusual_categories",
    "visible_orders", "order_search", "card_email_mismatch", "card_details_mismatch", "delete_users_cascade",
    "apply_updates_keep_blank", "owned_changes_only", "stream_velocity",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert not any(f in text for f in FORBIDDEN)


def test_patterns_read_only_their_columns(spark, tmp_path, sf_dir):
    path = str(tmp_path / "cards")
    fx.transactions(spark, sf_dir).write.parquet(path)
    text = plan(reports.suspicious_patterns(spark.read.parquet(path)))
    schema = text[text.index("ReadSchema: "):]
    assert "address_city" not in schema and "email" not in schema and "card_number" in schema
    assert text.count("FileScan") == 1


def test_top_values_limit_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(entry.queries()["top_values"](spark, sf_dir))
