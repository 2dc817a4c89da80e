"""Counts and distinct counts of a group, carried back to each of its rows.

Rows whose key is null keep a null measure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.key_tables import KeyTable, Measure, fit_key_tables
from fraudloom.schemas import KEY_COLS

FEATURES = {
    m.out: m
    for m in [
        Measure("transactions_per_card", "card_number", "count", "id"),
        Measure("transactions_per_customer", "customer_id", "count", "id"),
        Measure("transactions_per_state", "address_state", "count", "id"),
        Measure("transactions_per_zip", "address_zip", "count", "id"),
        Measure("card_usage_count", "card_number", "count", "id"),
        Measure("customer_transaction_count", "customer_id", "count", "id"),
        Measure("country_freq", "address_country", "count", "id"),
        Measure("state_freq", "address_state", "count", "id"),
        Measure("email_domain_freq", "email_domain", "count", "id"),
        Measure("users_per_card", "card_number", "distinct", "user_id"),
        Measure("addresses_per_card", "card_number", "distinct", "address_zip"),
        Measure("cards_per_customer", "customer_id", "distinct", "card_number"),
        Measure("cards_per_user", "user_id", "distinct", "card_number"),
        Measure("card_user_count", "card_number", "count", "user_id"),
        Measure("customer_id_count", "customer_id", "count", "user_id"),
        Measure("multiple_states", "customer_id", "many", "address_state"),
        Measure("multiple_countries", "customer_id", "many", "address_country"),
    ]
}


def fit_group_features(
    df: DataFrame, names: list[str], fill_before_group: dict[str, str] | None = None, approx: bool = False
) -> dict[str, KeyTable]:
    if fill_before_group:
        df = df.fillna(fill_before_group)
    return fit_key_tables(df, [FEATURES[n] for n in names], approx=approx)


def add_group_features(
    df: DataFrame,
    names: list[str],
    fill_before_group: dict[str, str] | None = None,
    approx: bool = False,
    row_key: list[str] | None = None,
    tables: dict[str, KeyTable] | None = None,
) -> DataFrame:
    """``df`` with one column per named feature.

    ``fill_before_group`` makes missing values a group of their own. ``tables``
    reuses measures learned earlier, for example on the training rows.
    """
    tables = tables or fit_group_features(df, names, fill_before_group, approx)
    out = df.fillna(fill_before_group) if fill_before_group else df
    columns = out.columns
    for table in tables.values():
        out = table.join_to(out, row_key or KEY_COLS)
    flags = {n: F.coalesce(n, F.lit(False)) for n in names if FEATURES[n].fn == "many"}
    return out.withColumns(flags).select(*columns, *names) if flags else out.select(*columns, *names)
