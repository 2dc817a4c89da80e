"""Card rows with deterministic scores and flags, for checking reports in SQL.

The scores are sums of standardised group counts, so both engines agree on them
before any detector is trained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import clean
from fraudloom.operators.flags import contamination_flag, percentile_flag
from fraudloom.operators.group_features import FEATURES, add_group_features
from fraudloom.plans.oracle_views import NUM, SECOND, grouped, scaled
from fraudloom.plans.registry import AS_OF, rounded
from fraudloom.session import cut_lineage
from fraudloom.sources.fixtures import transactions

SCORED_ON = ["transactions_per_card", "cards_per_customer", "addresses_per_card", "users_per_card"]
COUNTS = [
    "transactions_per_card", "transactions_per_customer", "transactions_per_state", "transactions_per_zip",
    "email_domain_freq", "cards_per_customer", "addresses_per_card", "users_per_card", "cards_per_user",
]
REPORTED = [*COUNTS, "card_expiry_months"]


def scored_transactions(spark: SparkSession, sf_dir: str, counts: list[str] = SCORED_ON) -> DataFrame:
    """Card rows + counts + ``score``, ``error`` and one 0/1 column per detector."""
    df = transactions(spark, sf_dir)
    plain = df.columns
    df = df.withColumn("email_domain", text.email_domain_guarded("email"))
    df = cut_lineage(add_group_features(df, counts).select(*plain, *counts))
    scales = clean.fit_scale(df, SCORED_ON)
    z = [F.coalesce(scales[c].apply(F.col(c)), F.lit(0.0)) for c in SCORED_ON]
    size, square = F.abs(z[0]), z[0] * z[0]
    for x in z[1:]:
        size, square = size + F.abs(x), square + x * x
    df = df.withColumn("score", -rounded(size, 9)).withColumn("error", rounded(square / len(z), 9))
    df = df.withColumn("DBSCAN", F.when(F.col("addresses_per_card") > 2, 1).otherwise(0))
    df = contamination_flag(df, "score", 0.01, "IsolationForest")
    return percentile_flag(df, "error", 98, "Autoencoder")


def reported_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored_transactions(spark, sf_dir, COUNTS)
    expiry = text.card_expiry_months(
        text.to_number("exp_month", 1), text.to_number("exp_year", AS_OF.year), AS_OF.year
    )
    return df.withColumn("card_expiry_months", expiry)


def _aggregate(name):
    m = FEATURES[name]
    return f"count({m.value})" if m.fn == "count" else f"count(DISTINCT {m.value})"


_Z = [f"coalesce(z.{c}, 0.0)" for c in SCORED_ON]
_MONTH, _YEAR = NUM.format(c="exp_month", d=1), NUM.format(c="exp_year", d=AS_OF.year)

SCORED_CTES = {
    "dom": f"SELECT *, coalesce({SECOND}, 'unknown') AS email_domain FROM tx",
    "counted": grouped("dom", [(n, FEATURES[n].key, _aggregate(n)) for n in COUNTS]),
    "z": scaled("counted", SCORED_ON),
    "measured": f"""SELECT counted.* EXCLUDE (email_domain),
        -(round({' + '.join(f'abs({x})' for x in _Z)}, 9) + 0.0) AS score,
        round(({' + '.join(f'{x} * {x}' for x in _Z)}) / {len(_Z)}, 9) + 0.0 AS error,
        ({_YEAR} - {AS_OF.year}) * 12 + {_MONTH} AS card_expiry_months
        FROM counted JOIN z ON counted.id = z.id""",
    "scored": """SELECT *, CASE WHEN addresses_per_card > 2 THEN 1 ELSE 0 END AS "DBSCAN",
        CASE WHEN score < (SELECT quantile_cont(score, 0.01) FROM measured) THEN 1 ELSE 0 END AS "IsolationForest",
        CASE WHEN error > (SELECT quantile_cont(error, 0.98) FROM measured) THEN 1 ELSE 0 END AS "Autoencoder"
        FROM measured""",
}
