"""Flags on given scores, and the reports on flagged rows."""

from itertools import combinations

from pyspark.sql import functions as F

from fraudloom.operators import flags, reports
from fraudloom.plans.oracle_views import SECOND, r6, with_views
from fraudloom.plans.queries_rows import CARD_COLUMNS
from fraudloom.plans.registry import KEYS, query, round_columns
from fraudloom.plans.stand_in import REPORTED, SCORED_CTES, SCORED_ON, reported_transactions, scored_transactions
from fraudloom.sources.fixtures import transactions

FLAGS = reports.FLAGS
_QUOTED = ", ".join(f'"{f}"' for f in FLAGS)


def scored_sql(body):
    return with_views(body, "tx", extra=SCORED_CTES)


@query("contamination_flag", scored_sql('SELECT id, user_id, score, "IsolationForest" AS fraud_flag FROM scored'))
def contamination_flag(spark, sf):
    df = scored_transactions(spark, sf).select(*KEYS, "score")
    return flags.contamination_flag(df, "score", 0.01)


@query("percentile_flag", scored_sql('SELECT id, user_id, error, "Autoencoder" AS fraud_flag FROM scored'))
def percentile_flag(spark, sf):
    return flags.percentile_flag(scored_transactions(spark, sf).select(*KEYS, "error"), "error", 98)


_LEVELS = [0.01, 0.02, 0.03]


@query("sensitivity", scored_sql(
    "SELECT id, user_id, " + ", ".join(
        f"CASE WHEN score < (SELECT quantile_cont(score, {c}) FROM measured) THEN 1 ELSE 0 END AS flag_{int(c * 100)}"
        for c in _LEVELS) + " FROM scored"))
def sensitivity(spark, sf):
    df = scored_transactions(spark, sf).select(*KEYS, "score")
    for c in _LEVELS:
        df = flags.contamination_flag(df, "score", c, f"flag_{int(c * 100)}")
    return df.drop("score")


@query("attach_flags", scored_sql(
    f'SELECT {", ".join(CARD_COLUMNS)}, "IsolationForest" AS fraud_flag, score AS anomaly_score '
    'FROM scored WHERE "IsolationForest" = 1'))
def attach_flags(spark, sf):
    found = scored_transactions(spark, sf).select(
        *KEYS, F.col("IsolationForest").alias("fraud_flag"), F.col("score").alias("anomaly_score")
    )
    return flags.attach_flags(transactions(spark, sf), found, KEYS, only="fraud_flag")


_TRUTH = "(" + " + ".join(f"power({c} - (SELECT avg({c}) FROM t), 2)" for c in SCORED_ON) + f") / {len(SCORED_ON)} > 2.0"


@query("pseudo_label_f1", with_views(
    "SELECT tp, fp, fn, " + r6("CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END", "f1")
    + f""" FROM (SELECT count(*) FILTER (WHERE truth AND guess) AS tp, count(*) FILTER (WHERE NOT truth AND guess) AS fp,
      count(*) FILTER (WHERE truth AND NOT guess) AS fn FROM (SELECT {_TRUTH} AS truth, error > 2.0 AS guess FROM t))""",
    "tx", extra={**SCORED_CTES, "t": f"SELECT * FROM scored WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SCORED_ON)}"}))
def pseudo_label_f1(spark, sf):
    df = scored_transactions(spark, sf).dropna(subset=SCORED_ON)
    return round_columns(flags.pseudo_label_f1(df, SCORED_ON, "error", 2.0), ["f1"])


@query("fraud_rate_summary", scored_sql(
    'SELECT count(*) AS total_transactions, cast(sum("IsolationForest") AS bigint) AS flagged_transactions, '
    + r6('sum("IsolationForest") / count(*) * 100', "fraud_rate") + " FROM scored"))
def fraud_rate_summary(spark, sf):
    return round_columns(reports.fraud_rate_summary(scored_transactions(spark, sf), "IsolationForest"), ["fraud_rate"])


_PATTERN_SQL = {
    "multiple_cards_per_customer": "SELECT customer_id FROM tx GROUP BY 1 HAVING count(DISTINCT card_number) > 3",
    "multiple_addresses": "SELECT card_number FROM tx GROUP BY 1 HAVING count(DISTINCT address_zip) > 2",
    "high_frequency_cards": "SELECT card_number FROM tx GROUP BY 1 HAVING count(id) > 10",
    "multiple_users_per_card": "SELECT card_number FROM tx GROUP BY 1 HAVING count(DISTINCT user_id) > 1",
}


@query("suspicious_patterns", with_views(
    " UNION ALL ".join(
        f"SELECT '{p}' AS pattern, count(*) AS n_rows FROM tx WHERE {s.split()[1]} IN ({s})"
        for p, s in _PATTERN_SQL.items()), "tx"))
def suspicious_patterns(spark, sf):
    return reports.suspicious_patterns(transactions(spark, sf))


_STATS = ["normal_mean", "normal_std", "fraud_mean", "fraud_std"]


@query("normal_vs_flagged", scored_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r6(f'avg({c}) FILTER (WHERE f = 0)', 'normal_mean')}, "
    f"{r6(f'stddev_samp({c}) FILTER (WHERE f = 0)', 'normal_std')}, {r6(f'avg({c}) FILTER (WHERE f = 1)', 'fraud_mean')}, "
    f"{r6(f'stddev_samp({c}) FILTER (WHERE f = 1)', 'fraud_std')} "
    f'FROM (SELECT *, "IsolationForest" AS f FROM scored)' for c in REPORTED)))
def normal_vs_flagged(spark, sf):
    df = reported_transactions(spark, sf)
    return round_columns(reports.normal_vs_flagged(df, "IsolationForest", REPORTED), _STATS)


_PLACES = ["address_state", "address_city", "address_country"]


@query("unusual_categories", scored_sql(f"""
    SELECT feature, value, {r6('flagged_share')}, {r6('normal_share')} FROM (
      SELECT feature, value, n1 / sum(n1) OVER (PARTITION BY feature) AS flagged_share,
             n0 / sum(n0) OVER (PARTITION BY feature) AS normal_share
      FROM (SELECT feature, value, count(*) FILTER (WHERE f = 1) AS n1, count(*) FILTER (WHERE f = 0) AS n0
            FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS value, " + '"IsolationForest" AS f FROM scored'
                                      for c in _PLACES)})
            WHERE value IS NOT NULL GROUP BY 1, 2))
    WHERE flagged_share > 2 * normal_share"""))
def unusual_categories(spark, sf):
    df = scored_transactions(spark, sf)
    return round_columns(
        reports.unusual_categories(df, "IsolationForest", _PLACES), ["flagged_share", "normal_share"]
    )


_DEVIATIONS = ", ".join(
    r6(f'abs({c} - (SELECT avg({c}) FROM scored WHERE "IsolationForest" = 0)) / '
       f'(SELECT stddev_samp({c}) FROM scored WHERE "IsolationForest" = 0)', f"{c}_std_deviation") for c in REPORTED)


@query("deviation_scores", scored_sql(
    f"SELECT id, user_id, 'Flagged by Isolation Forest' AS anomaly_details, {_DEVIATIONS} "
    'FROM scored WHERE "IsolationForest" = 1'))
def deviation_scores(spark, sf):
    df = reports.deviation_scores(reported_transactions(spark, sf), "IsolationForest", REPORTED)
    names = [f"{c}_std_deviation" for c in REPORTED]
    return round_columns(df.select(*KEYS, "anomaly_details", *names), names)


@query("model_summary", scored_sql(" UNION ALL ".join(
    f"""SELECT '{f}' AS model, count(*) AS n_flagged, count(DISTINCT address_country) AS n_countries,
    count(DISTINCT address_state) AS n_states, count(DISTINCT {SECOND}) AS n_email_domains
    FROM scored WHERE "{f}" = 1""" for f in FLAGS)))
def model_summary(spark, sf):
    return reports.model_summary(scored_transactions(spark, sf))


@query("model_overlap", scored_sql(" UNION ALL ".join(
    f"""SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) AS n_both FROM scored WHERE "{a}" = 1 AND "{b}" = 1"""
    for a, b in combinations(sorted(FLAGS), 2))))
def model_overlap(spark, sf):
    return reports.model_overlap(scored_transactions(spark, sf))


_TOP = " UNION ALL ".join(
    f"""SELECT '{f}' AS model, '{c}' AS feature, {e} AS value FROM scored WHERE "{f}" = 1"""
    for f in FLAGS
    for c, e in [("address_country", "address_country"), ("address_state", "address_state"), ("email_domain", SECOND)])


@query("top_values", scored_sql(f"""
    SELECT * FROM (SELECT model, feature, value, n,
      row_number() OVER (PARTITION BY model, feature ORDER BY n DESC, value) AS rank
      FROM (SELECT model, feature, value, count(*) AS n FROM ({_TOP}) WHERE value IS NOT NULL GROUP BY 1, 2, 3))
    WHERE rank <= 5"""))
def top_values(spark, sf):
    return reports.top_values(scored_transactions(spark, sf))


@query("flagged_extract", scored_sql(f'SELECT {", ".join(CARD_COLUMNS)}, {_QUOTED}, error AS "Autoencoder_Error" '
                                     'FROM scored WHERE "Autoencoder" = 1'))
def flagged_extract(spark, sf):
    df = scored_transactions(spark, sf).select(*CARD_COLUMNS, *FLAGS, F.col("error").alias("Autoencoder_Error"))
    return reports.flagged_extract(df, "Autoencoder")


@query("combined_results", scored_sql(
    f'SELECT {", ".join(CARD_COLUMNS)}, {_QUOTED}, error AS "Autoencoder_Error" FROM scored'))
def combined_results(spark, sf):
    found = scored_transactions(spark, sf)
    results = [found.select(*KEYS, "DBSCAN"), found.select(*KEYS, "IsolationForest"),
               found.select(*KEYS, "Autoencoder", F.col("error").alias("Autoencoder_Error"))]
    return reports.combined_results(transactions(spark, sf), results, KEYS)


@query("drift_metrics", scored_sql(f"""
    SELECT paid_day, n, flagged, {r6('flagged_rate')}, {r6('score_q50')}, {r6('score_q99')}, {r6('mean_shift')} FROM (
      SELECT cast(o_orderdate AS date) AS paid_day, count(*) AS n, cast(sum("IsolationForest") AS bigint) AS flagged,
             sum("IsolationForest") / count(*) AS flagged_rate, quantile_cont(score, 0.5) AS score_q50,
             quantile_cont(score, 0.99) AS score_q99,
             avg(transactions_per_card) - (SELECT avg(transactions_per_card) FROM scored) AS mean_shift
      FROM scored JOIN orders ON o_orderkey = id GROUP BY 1)"""))
def drift_metrics(spark, sf):
    from fraudloom.operators.monitor import drift_metrics as drift
    from fraudloom.sources.fixtures import table

    days = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS paid_day")
    df = scored_transactions(spark, sf).join(days, "id")
    out = drift(df, "paid_day", "score", "IsolationForest", ["transactions_per_card"])
    out = out.withColumnRenamed("transactions_per_card_shift", "mean_shift")
    return round_columns(out, ["flagged_rate", "score_q50", "score_q99", "mean_shift"])
