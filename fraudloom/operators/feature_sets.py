"""The five feature sets the detectors train on.

A set is declared as a ``FeatureSet``; ``fit`` learns its lookup tables, fills
and scales, and ``transform`` applies them to any card rows, so new rows see the
training vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import clean
from fraudloom.operators.group_features import FEATURES
from fraudloom.operators.key_tables import KeyTable, code_column, fit_key_tables
from fraudloom.schemas import KEY_COLS
from fraudloom.session import cut_lineage


@dataclass(frozen=True)
class FeatureSet:
    """``counts`` are group features; ``codes`` map a column to its missing text.

    A missing text of None leaves missing values uncoded.
    """

    name: str
    prepare: Callable[[DataFrame, date], DataFrame]
    counts: list[str]
    codes: dict[str, str | None]
    columns: list[str]
    imputer: str | None = None


@dataclass
class FeatureModel:
    spec: FeatureSet
    as_of: date
    tables: dict[str, KeyTable]
    fills: dict[str, object] = field(default_factory=dict)
    scales: dict[str, clean.Scale] = field(default_factory=dict)
    row_key: list[str] = field(default_factory=lambda: list(KEY_COLS))
    #: What a value gets that training did not have: ``next`` free code, or ``error``.
    unseen: str = "next"

    def raw(self, df: DataFrame, keep: list[str] | None = None, live: list[str] | None = None) -> DataFrame:
        """Row key, ``keep`` columns and unscaled features, as doubles.

        ``live`` names counts that the rows carry themselves instead of the tables.
        """
        prepared = self.spec.prepare(df, self.as_of)
        kept = [F.col(c).alias(f"_keep_{c}") for c in keep or []]
        prepared = prepared.select("*", *kept)
        for key, table in self.tables.items():
            table = replace(table, table=table.table.drop(*(live or [])))
            label = self.spec.codes.get(key)
            if label is not None:
                prepared = prepared.withColumn(f"_has_{key}", F.col(key).isNotNull()).fillna({key: label})
            prepared = table.join_to(prepared, self.row_key)
            if label is not None:
                counts = [c for c in table.table.columns if c not in (key, table.code)]
                prepared = prepared.withColumns({c: F.when(F.col(f"_has_{key}"), F.col(c)) for c in counts})
        return prepared.select(
            *self.row_key,
            *[F.col(f"_keep_{c}").alias(c) for c in keep or []],
            *[self._feature(c).cast("double").alias(self._name(c)) for c in self.spec.columns],
        )

    def _feature(self, column: str) -> Column:
        if column in self.spec.codes:
            code = F.col(code_column(column))
            if self.unseen == "error":
                complaint = F.raise_error(F.concat(F.lit(f"unseen value in {column}: "), F.col(column).cast("string")))
                other = complaint.cast("long")
            else:
                other = F.lit(self.tables[column].profile.distinct).cast("long")
            return F.when(F.col(column).isNotNull() & code.isNull(), other).otherwise(code)
        if column in FEATURES and FEATURES[column].fn == "many":
            return F.coalesce(F.col(column), F.lit(False)).cast("int")
        return F.col(column)

    def _name(self, column: str) -> str:
        return f"f_{column}" if column in self.row_key else column

    @property
    def features(self) -> list[str]:
        return [self._name(c) for c in self.spec.columns]

    def finish(self, raw: DataFrame) -> DataFrame:
        return clean.standardize(clean.impute(raw, self.fills), self.scales)

    def transform(self, df: DataFrame, keep: list[str] | None = None, live: list[str] | None = None) -> DataFrame:
        return self.finish(self.raw(df, keep, live))


def fit_tables(
    df: DataFrame, spec: FeatureSet, as_of: date, row_key: list[str] | None = None, approx: bool = False
) -> FeatureModel:
    """Lookup tables only: one per key, holding its counts and its code."""
    labels = {c: v for c, v in spec.codes.items() if v is not None}
    measures = [FEATURES[n] for n in spec.counts]
    tables = fit_key_tables(spec.prepare(df, as_of), measures, list(spec.codes), labels, approx)
    return FeatureModel(spec, as_of, tables, row_key=list(row_key or KEY_COLS))


def fit(
    df: DataFrame, spec: FeatureSet, as_of: date, row_key: list[str] | None = None, approx: bool = False
) -> tuple[FeatureModel, DataFrame]:
    """The fitted model and the training rows' unscaled features, written once."""
    model = fit_tables(df, spec, as_of, row_key, approx)
    raw = cut_lineage(model.raw(df))
    names = model.features
    if spec.imputer == "most_frequent":
        model.fills = clean.fit_most_frequent(raw, names)
    elif spec.imputer == "mean":
        model.fills = clean.fit_mean(raw, names)
    model.scales = clean.fit_scale(clean.impute(raw, model.fills), names)
    return model, raw


def _prepare_comparison(df: DataFrame, as_of: date) -> DataFrame:
    return clean.fill_missing(df).withColumns(
        {
            "email_domain": text.email_domain_second(F.coalesce("email", F.lit(clean.UNKNOWN_EMAIL))),
            "exp_month": text.to_number("exp_month", 1),
            "exp_year": text.to_number("exp_year", 2024),
        }
    )


def _prepare_forest(df: DataFrame, as_of: date) -> DataFrame:
    dated = df.withColumns(
        {
            "email_domain": text.email_domain_guarded("email"),
            "exp_month": text.to_number("exp_month", 1),
            "exp_year": text.to_number("exp_year", as_of.year),
        }
    )
    return dated.withColumn("card_expiry_months", text.card_expiry_months("exp_month", "exp_year", as_of.year))


def _prepare_autoencoder(df: DataFrame, as_of: date) -> DataFrame:
    dated = df.withColumns(
        {"exp_month": text.to_number("exp_month", 1), "exp_year": text.to_number("exp_year", 2024)}
    )
    left = text.months_to_expiry("exp_month", "exp_year", as_of.year, as_of.month)
    return dated.withColumn("months_to_expiry", left)


def _prepare_cluster(df: DataFrame, as_of: date) -> DataFrame:
    return df.withColumns({"exp_month": text.to_number("exp_month"), "exp_year": text.to_number("exp_year")})


# The features of each set, in order.
_COMPARISON_COUNTS = [
    "card_usage_count", "customer_transaction_count", "email_domain_freq", "country_freq", "state_freq",
]
_COMPARISON_CODES = {"email_domain": None, "address_country": None, "address_state": None}
_COMPARISON_COLUMNS = [*_COMPARISON_COUNTS, *_COMPARISON_CODES, "exp_month", "exp_year"]
_FLAGS = ["multiple_states", "multiple_countries"]

COMPARISON10 = FeatureSet(
    "comparison10", _prepare_comparison, _COMPARISON_COUNTS, _COMPARISON_CODES, _COMPARISON_COLUMNS
)
COMPARISON12 = FeatureSet(
    "comparison12", _prepare_comparison, _COMPARISON_COUNTS + _FLAGS, _COMPARISON_CODES, _COMPARISON_COLUMNS + _FLAGS
)

_FOREST_COUNTS = [
    "transactions_per_card", "transactions_per_customer", "transactions_per_state", "transactions_per_zip",
    "email_domain_freq", "cards_per_customer", "addresses_per_card", "users_per_card", "cards_per_user",
]
_FOREST_CODES = {
    c: clean.UNKNOWN_CATEGORY
    for c in ["address_state", "address_city", "address_country", "email_domain", "card_number", "address_zip"]
}
FOREST = FeatureSet(
    "forest", _prepare_forest, _FOREST_COUNTS, _FOREST_CODES,
    ["user_id", *_FOREST_CODES, "exp_month", "exp_year", *_FOREST_COUNTS, "card_expiry_months"],
    imputer="most_frequent",
)

_AUTOENCODER_COUNTS = [
    "transactions_per_card", "users_per_card", "addresses_per_card", "transactions_per_state", "transactions_per_zip",
]
# Fixed value: the text a missing category is encoded as.
_AUTOENCODER_CODES = {c: "None" for c in ["address_state", "address_city", "address_country", "address_zip"]}
AUTOENCODER = FeatureSet(
    "autoencoder", _prepare_autoencoder, _AUTOENCODER_COUNTS, _AUTOENCODER_CODES,
    ["exp_month", "exp_year", *_AUTOENCODER_CODES, *_AUTOENCODER_COUNTS, "months_to_expiry"],
    imputer="mean",
)

CLUSTER = FeatureSet(
    "cluster", _prepare_cluster, ["card_user_count", "customer_id_count"],
    {"address_country": None, "address_state": None},
    ["card_user_count", "customer_id_count", "address_country", "address_state", "exp_month", "exp_year"],
)

SETS = {s.name: s for s in [COMPARISON10, COMPARISON12, FOREST, AUTOENCODER, CLUSTER]}
