"""Readers, writers, saved models and whole jobs, as round trips through the shared folder."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from fraudloom.operators import feature_sets, iforest, reports
from fraudloom.plans.oracle_views import r6, with_views
from fraudloom.plans.queries_detect import _COUNTED, _LITERAL, _LITERAL_SCORE, _ON, SEED, _counted_rows
from fraudloom.plans.registry import AS_OF, KEYS, query, round_columns
from fraudloom.plans.stand_in import SCORED_CTES, scored_transactions
from fraudloom.session import cut_lineage, shared_folder
from fraudloom.sources import fixtures as fx
from fraudloom.sources import readers
from fraudloom.sources.writers import write_report
from fraudloom.streaming import scoring


def _folder(spark, name):
    return f"{shared_folder(spark)}/round_trips/{name}-{uuid.uuid4().hex}"


@query("scan_transactions_csv", with_views("SELECT * FROM tx", "tx"))
def scan_transactions_csv(spark, sf):
    cards, path = fx.transactions(spark, sf), _folder(spark, "csv")
    write_report(cards, path, "csv")
    return readers.read_csv(spark, path, cards.schema)


@query("write_report", with_views(
    """SELECT id, user_id, address_country, "IsolationForest" FROM scored WHERE "IsolationForest" = 1""", "tx", extra=SCORED_CTES))
def report_round_trip(spark, sf):
    path = _folder(spark, "report")
    flagged = reports.flagged_extract(scored_transactions(spark, sf), "IsolationForest")
    write_report(flagged.select(*KEYS, "address_country", "IsolationForest"), path, "parquet", ["IsolationForest"])
    return readers.read_table(spark, path)


@query("import_model_dump", with_views("SELECT * FROM shop_users", "shop_users"))
def import_model_dump(spark, sf):
    """Users written as {model, pk, fields} records, one per line, and read back as a table."""
    users, path = fx.shop_users(spark, sf), _folder(spark, "dump")
    fields = F.to_json(F.struct("username", "email", "is_staff"), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"model": "account.user", "pk": '), F.col("id").cast("string"), F.lit(', "fields": '), fields, F.lit("}"))
    users.select(line.alias("value")).write.text(path)
    return readers.read_model_dump(spark, path, {"account.user": users.schema}, (), multi_line=False)["account.user"]


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]


@query("describe_table", " UNION ALL ".join(
    f"SELECT (SELECT cast(column_index - 1 AS int) FROM duckdb_columns() WHERE table_name = 'customer' AND column_name = '{c}' "
    f"LIMIT 1) AS position, '{c}' AS column_name, count({c}) AS n_values FROM customer" for c in _CUSTOMER))
def describe_table(spark, sf):
    """Columns of a table with their positions and how many values each holds."""
    name, customers = f"customer_{uuid.uuid4().hex}", fx.table(spark, sf, "customer")
    customers.createOrReplaceTempView(name)
    found = readers.describe_table(spark, name).select("position", "column_name")
    counts = customers.agg(*[F.count(c).alias(c) for c in customers.columns])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in customers.columns])).alias("v"))
    return found.join(long.select("v.*"), "column_name").select("position", "column_name", "n_values")


@query("require_table", "SELECT 'customer' AS table_name, count(*) AS n_rows FROM customer "
                        "UNION ALL SELECT 'absent', count(*) - count(*) FROM orders")
def require_table(spark, sf):
    """Rows of a table that is there; none, and no error beyond the check's own, for one that is not."""
    name = f"customer_{uuid.uuid4().hex}"
    fx.table(spark, sf, "customer").createOrReplaceTempView(name)
    rows = []
    for label, asked in (("customer", name), ("absent", f"absent_{name}")):
        try:
            readers.require_table(spark, asked)
            rows.append((label, spark.table(asked).count()))
        except ValueError:
            rows.append((label, 0))
    return spark.createDataFrame(rows, "table_name string, n_rows long")


@query("save_load_model", with_views(
    f"""SELECT id, user_id, CASE WHEN transactions_per_card IS NOT NULL AND users_per_card IS NOT NULL
    THEN {r6(_LITERAL_SCORE, 'x', 9).removesuffix(' AS x')} END AS anomaly_score FROM counted""", "tx", extra=_COUNTED))
def save_load_model(spark, sf):
    path = _folder(spark, "forest")
    iforest.ForestModel(_ON, 16, SEED, _LITERAL).save(spark, path)
    model = iforest.ForestModel.load(spark, path)
    return round_columns(iforest.isolation_forest_score(model, _counted_rows(spark, sf)), ["anomaly_score"], 9)


def _literal_detector(cards, flag_below, watch_below):
    """A detector with a given forest on two counts, whose lookup tables come from ``cards``."""
    spec = feature_sets.FeatureSet("literal", lambda df, as_of: df, _ON, {}, _ON)
    model = feature_sets.fit_tables(cards, spec, AS_OF)
    return scoring.Detector(model, iforest.ForestModel(_ON, 16, SEED, _LITERAL), flag_below, watch_below)


_LEVEL = (
    "CASE WHEN anomaly_score IS NULL THEN 'unscored' WHEN anomaly_score < -0.5 THEN 'high' "
    "WHEN anomaly_score < -0.4 THEN 'medium' ELSE 'low' END AS risk_level, "
    "cast(anomaly_score < -0.5 AS int) AS fraud_flag"
)
_OLD = "SELECT * FROM tx WHERE id % 5 <> 0"


def _scored_by_old(source, columns):
    counts = ", ".join(f"g{i}.{n}" for i, n in enumerate(_ON))
    return (
        f"SELECT {columns}, {r6('raw', 'anomaly_score', 9)}, {_LEVEL.replace('anomaly_score', 'raw')} FROM ("
        f"SELECT *, CASE WHEN transactions_per_card IS NOT NULL AND users_per_card IS NOT NULL THEN {_LITERAL_SCORE} END AS raw "
        f"FROM (SELECT s.*, {counts} FROM {source} s "
        "LEFT JOIN (SELECT card_number AS k, count(id) AS transactions_per_card FROM old GROUP BY 1) g0 ON s.card_number = g0.k "
        "LEFT JOIN (SELECT card_number AS k, count(DISTINCT user_id) AS users_per_card FROM old GROUP BY 1) g1 ON s.card_number = g1.k))"
    )


@query("score_new_cards", with_views(_scored_by_old("tx", "id, user_id"), "tx", extra={"old": _OLD}))
def score_new_cards(spark, sf):
    """All rows scored by what four fifths of them taught: cards not seen there are ``unscored``, never low."""
    cards = fx.transactions(spark, sf)
    model = _literal_detector(cards.filter("id % 5 <> 0"), -0.5, -0.4)
    return round_columns(model.score(cards), ["anomaly_score"], 9)


@query("backfill_scores", with_views(
    _scored_by_old("dated", "id, user_id, strftime(day, '%Y-%m-%d') AS day"), "tx",
    extra={"old": _OLD, "dated": "SELECT tx.*, o_orderdate AS day FROM tx JOIN orders ON id = o_orderkey"}))
def backfill_scores(spark, sf):
    """Every day of the table, written twice; the days stand once."""
    cards = fx.transactions(spark, sf)
    days = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format(F.trunc("o_orderdate", "year"), "yyyy-MM-dd").alias("year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    dated, path = cards.join(days, "id"), _folder(spark, "backfill")
    model = _literal_detector(cards.filter("id % 5 <> 0"), -0.5, -0.4)
    for _ in range(2):
        scoring.backfill_scores(dated, model, path, "year", ["day"])
    return round_columns(spark.read.parquet(path).drop("year"), ["anomaly_score"], 9)


@query("retrain_on_window")
def retrain_on_window(spark, sf):
    """A detector retrained on two years of rows, scoring all: a property query, its forest is random."""
    dated = fx.transactions(spark, sf).join(
        fx.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS day"), "id"
    )
    model = scoring.retrain_on_window(
        dated, "day", date(1995, 1, 1), date(1997, 1, 1), feature_sets.CLUSTER, n_estimators=50
    )
    return model.score(dated)


@query("combined_comparison", with_views(
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE "DBSCAN" = 1) AS n_dbscan,
    count(*) FILTER (WHERE "IsolationForest" = 1) AS n_forest, count(*) FILTER (WHERE "Autoencoder" = 1) AS n_autoencoder,
    count(*) FILTER (WHERE user_id IS NULL) AS n_without_user FROM scored""", "tx", extra=SCORED_CTES))
def combined_comparison(spark, sf):
    """The three-model comparison on given flags: each detector's rows joined back, none lost."""
    scored = scored_transactions(spark, sf)
    found = [scored.select(*KEYS, f) for f in reports.FLAGS]
    combined = reports.combined_results(fx.transactions(spark, sf), found, KEYS)
    hits = [F.count_if(F.col(f) == 1).alias(n) for f, n in zip(reports.FLAGS, ("n_dbscan", "n_forest", "n_autoencoder"))]
    return combined.agg(F.count(F.lit(1)).alias("n_rows"), *hits, F.count_if(F.col("user_id").isNull()).alias("n_without_user"))
