"""Detectors, searches and their training measures."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fraudloom.operators import autoencoder as ae
from fraudloom.operators import clean, dbscan, feature_sets, flags, iforest, search, silhouette
from fraudloom.operators.group_features import FEATURES, add_group_features
from fraudloom.operators.quantile import exact_percentile
from fraudloom.plans.oracle_views import grouped, r6, scaled, with_views
from fraudloom.plans.queries_groups import CLUSTER_CTES, comparison_ctes
from fraudloom.plans.registry import AS_OF, KEYS, query, round_columns, rounded
from fraudloom.session import cut_lineage
from fraudloom.sources.fixtures import embeddings, transactions

SEED = 42


def scaled_rows(spark, sf, spec=feature_sets.COMPARISON10, every=False):
    """Scaled feature rows, written once, and the feature names; ``every`` keeps rows that lack a feature."""
    model, raw = feature_sets.fit(transactions(spark, sf), spec, AS_OF)
    rows = model.finish(raw)
    return cut_lineage(rows if every else clean.drop_incomplete(rows, model.features)), model.features


def rounded_rows(spark, sf, spec=feature_sets.COMPARISON10):
    """All scaled rows at six digits, so that SQL compares the same numbers."""
    rows, names = scaled_rows(spark, sf, spec, every=True)
    return round_columns(rows, names), names


@query("isolation_forest_fit")
def isolation_forest_fit(spark, sf):
    rows, names = scaled_rows(spark, sf, feature_sets.FOREST)
    forest = iforest.isolation_forest_fit(rows, names, 200, "auto", True, SEED)
    return spark.createDataFrame(forest.nodes, iforest._NODE_SCHEMA)


@query("isolation_forest_score")
def isolation_forest_score(spark, sf):
    rows, names = scaled_rows(spark, sf, feature_sets.FOREST)
    forest = iforest.isolation_forest_fit(rows, names, 200, "auto", True, SEED)
    scored = cut_lineage(iforest.isolation_forest_score(forest, rows))
    return flags.contamination_flag(scored, "anomaly_score", 0.01)


@query("isolation_forest_search")
def isolation_forest_search(spark, sf):
    rows, names = scaled_rows(spark, sf, feature_sets.COMPARISON12)
    return search.isolation_forest_search(rows, names).runs


DIMS = 64
_VECTORS = "SELECT vec_id, label, " + ", ".join(f"cast(embedding[{i + 1}] AS double) AS e{i}" for i in range(DIMS)) + " FROM embeddings"


def _embedded(spark, sf):
    return embeddings(spark, sf).select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)]
    )


def _silhouette_sql(distance):
    gap = " + ".join(f"(a.e{i} - b.e{i}) * (a.e{i} - b.e{i})" for i in range(DIMS))
    return f"""WITH vec AS ({_VECTORS}),
    t AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance.format(gap)}) AS total, count(*) AS n
          FROM vec a, vec b GROUP BY 1, 2, 3),
    s AS (SELECT vec_id, max(CASE WHEN own = other THEN total / greatest(n - 1, 1) END) AS a,
                 max(CASE WHEN own = other THEN n END) AS n_own,
                 min(CASE WHEN own <> other THEN total / n END) AS b FROM t GROUP BY 1)
    SELECT {r6('avg(CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END)', 'silhouette')} FROM s"""


def _silhouette(name, metric, distance):
    @query(name, _silhouette_sql(distance))
    def run(spark, sf):
        value = silhouette.silhouette(_embedded(spark, sf), [f"e{i}" for i in range(DIMS)], "label", metric)
        return spark.createDataFrame([(value,)], "silhouette double").select(rounded("silhouette").alias("silhouette"))


_silhouette("silhouette", "squared", "({})")
_silhouette("silhouette_euclidean", "euclidean", "sqrt({})")

_TEN = feature_sets.COMPARISON10.columns
_POINTS = {
    **comparison_ctes(feature_sets.COMPARISON10),
    "z": scaled("features", _TEN),
    "every": "SELECT id, user_id, " + ", ".join(f"round({c}, 6) + 0.0 AS x{i}" for i, c in enumerate(_TEN)) + " FROM z",
    "p": "SELECT * FROM every WHERE " + " AND ".join(f"x{i} IS NOT NULL" for i in range(len(_TEN))),
    "v": "SELECT " + ", ".join(f"x{i}" for i in range(len(_TEN))) + ", count(*) AS w, "
         "row_number() OVER () AS v FROM p GROUP BY ALL",
    "near": "SELECT a.v AS a, b.v AS b, b.w AS w, "
            + " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(_TEN)))
            + " AS d FROM v a, v b WHERE d <= 0.7 * 0.7",
}


def _noise_sql(eps, m):
    return f"""SELECT v.v FROM v WHERE v.v NOT IN (
        SELECT a FROM near WHERE d <= {eps} * {eps} AND b IN (
            SELECT a FROM near WHERE d <= {eps} * {eps} GROUP BY a HAVING sum(w) >= {m}))"""


def _points_sql(body):
    # the vectors' row numbers must stay the same wherever they are read
    text = with_views(body, "tx", extra=_POINTS)
    return text.replace("v AS (SELECT x0", "v AS MATERIALIZED (SELECT x0").replace("near AS (", "near AS MATERIALIZED (")


@query("dbscan_noise", _points_sql(
    "SELECT p.id, p.user_id, CASE WHEN v.v IS NOT NULL THEN cast(n.v IS NOT NULL AS int) END AS \"DBSCAN\" "
    "FROM every p LEFT JOIN v ON " + " AND ".join(f"p.x{i} = v.x{i}" for i in range(len(_TEN)))
    + f" LEFT JOIN ({_noise_sql(0.5, 5)}) n ON n.v = v.v"))
def dbscan_noise(spark, sf):
    rows, names = rounded_rows(spark, sf)
    return dbscan.dbscan_noise(rows, names, 0.5, 5)


@query("dbscan_search", _points_sql(" UNION ALL ".join(
    f"SELECT cast({e} AS double) AS eps, {m} AS min_samples, cast(coalesce(sum(v.w), 0) AS bigint) AS n_outliers "
    f"FROM v WHERE v.v IN ({_noise_sql(e, m)})"
    for e in dbscan.EPS_VALUES for m in dbscan.MIN_SAMPLES_VALUES)))
def dbscan_search(spark, sf):
    rows, names = rounded_rows(spark, sf)
    return dbscan.dbscan_search(rows, names).runs


_SIX = feature_sets.CLUSTER.columns
_X6 = [f"x{i}" for i in range(len(_SIX))]
#: Vectors are numbered by their least row key; labels run along core links until none falls.
_CLUSTER_SQL = f"""WITH RECURSIVE every AS MATERIALIZED (
  SELECT id, user_id, {', '.join(f'round({c}, 6) + 0.0 AS {x}' for c, x in zip(_SIX, _X6))}
  FROM ({with_views(scaled('features', _SIX), 'tx', extra=CLUSTER_CTES)})),
v AS MATERIALIZED (
  SELECT {', '.join(_X6)}, count(*) AS w, row_number() OVER (ORDER BY min(id)) AS v
  FROM every WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _X6)} GROUP BY {', '.join(_X6)}),
near AS MATERIALIZED (
  SELECT a.v AS a, b.v AS b, b.w AS w FROM v a, v b WHERE {' + '.join(f'(a.{x} - b.{x}) * (a.{x} - b.{x})' for x in _X6)} <= 0.25),
core AS MATERIALIZED (SELECT a AS v FROM near GROUP BY a HAVING sum(w) >= 5),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach(v, least) USING KEY (v) AS (
  SELECT v, v FROM core
  UNION
  SELECT l.b, min(r.least) FROM reach r JOIN links l ON l.a = r.v JOIN recurring.reach t ON t.v = l.b WHERE r.least < t.least GROUP BY l.b),
numbered AS (SELECT v, dense_rank() OVER (ORDER BY least) - 1 AS n FROM reach),
found AS (
  SELECT v, n FROM numbered
  UNION ALL
  SELECT a, min(n) FROM near JOIN numbered ON numbered.v = b WHERE a NOT IN (FROM core) GROUP BY a)
SELECT id, user_id, CASE WHEN v.v IS NOT NULL THEN coalesce(n, -1)::INT END AS cluster
FROM every LEFT JOIN v ON {' AND '.join(f'every.{x} = v.{x}' for x in _X6)} LEFT JOIN found ON found.v = v.v"""


@query("dbscan_clusters", _CLUSTER_SQL)
def dbscan_clusters(spark, sf):
    rows, names = rounded_rows(spark, sf, feature_sets.CLUSTER)
    return dbscan.dbscan_clusters(rows, names, 0.5, 5)


def _history(spark, model):
    rows = [(h["epoch"], h["loss"], h["val_loss"]) for h in model.history]
    return spark.createDataFrame(rows, "epoch int, loss double, val_loss double")


@query("autoencoder_fit")
def autoencoder_fit(spark, sf):
    rows, names = scaled_rows(spark, sf)
    return _history(spark, ae.autoencoder_fit(rows, names, ae.PLAIN, SEED))


@query("early_stopping")
def early_stopping(spark, sf):
    rows, names = scaled_rows(spark, sf, feature_sets.AUTOENCODER)
    train, _ = flags.split_train_test(rows, KEYS, 0.2, SEED)
    return _history(spark, ae.autoencoder_fit(train, names, ae.STANDALONE, SEED))


@query("training_metrics")
def training_metrics(spark, sf):
    rows, names = scaled_rows(spark, sf, feature_sets.AUTOENCODER)
    train, test = flags.split_train_test(rows, KEYS, 0.2, SEED)
    model = ae.autoencoder_fit(train, names, ae.STANDALONE, SEED)
    tested = cut_lineage(ae.autoencoder_error(model, test, [*KEYS, *names], "error"))
    threshold = exact_percentile(tested, "error", 0.95)
    f1 = flags.pseudo_label_f1(tested, names, "error", threshold).first()["f1"]
    return ae.training_metrics(model, f1, threshold, spark)


@query("pca_reconstruction")
def pca_reconstruction(spark, sf):
    """Flags of every row; the fit leaves out rows that lack a feature, which have no error and no flag."""
    rows, names = scaled_rows(spark, sf, every=True)
    errors = cut_lineage(ae.pca_error(ae.pca_fit(rows, names), rows))
    return flags.percentile_flag(errors, "Autoencoder_Error", 99, "Autoencoder")


@query("reconstruction_error",
       "SELECT vec_id, " + r6("list_sum(list_transform(embedding, lambda x: (x::double - x::double * 0.5) * "
                              "(x::double - x::double * 0.5))) / len(embedding)", "error", 9) + " FROM embeddings")
def reconstruction_error(spark, sf):
    halves = embeddings(spark, sf).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 0.5).alias("y"),
    )
    return round_columns(ae.reconstruction_error(halves, "x", "y"), ["error"], 9).select("vec_id", "error")


_BUCKET = "('0x' || substr(md5('{}|' || id || '|' || coalesce(cast(user_id AS varchar), '')), 1, 8))::BIGINT % 10000"


@query("split_train_test", with_views(f"SELECT id, user_id, {_BUCKET.format(SEED)} < 2000 AS is_test FROM tx", "tx"))
def split_train_test(spark, sf):
    train, test = flags.split_train_test(transactions(spark, sf).select(*KEYS), KEYS, 0.2, SEED)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


@query("validation_split", with_views(f"SELECT id, user_id, {_BUCKET.format(43)} < 2000 AS is_validation FROM tx", "tx"))
def validation_split(spark, sf):
    return flags.validation_split(transactions(spark, sf).select(*KEYS), KEYS)


# Two small trees on raw group counts: enough to rebuild every score in SQL.
_TREES = {"tree_id": [0, 0, 0, 0, 0, 1, 1, 1], "node_id": [0, 1, 2, 3, 4, 0, 1, 2]}
_LITERAL = pd.DataFrame({
    **_TREES,
    "feature": [0, -1, 1, -1, -1, 1, -1, -1], "threshold": [3.5, 0.0, 1.5, 0.0, 0.0, 2.5, 0.0, 0.0],
    "left": [1, 1, 3, 3, 4, 1, 1, 2], "right": [2, 1, 4, 3, 4, 2, 1, 2],
    "size": [16, 10, 6, 2, 4, 16, 13, 3], "depth": [0, 1, 1, 2, 2, 0, 1, 1],
})
_ON = ["transactions_per_card", "users_per_card"]
_COUNTED = {
    "counted": grouped("tx", [(n, FEATURES[n].key, f"count({'DISTINCT ' * (FEATURES[n].fn != 'count')}{FEATURES[n].value})") for n in _ON]),
}


def _leaf(i: int) -> str:
    """Depth of a literal leaf plus the mean depth of what it holds."""
    return repr(float(_LITERAL["depth"][i] + iforest.average_path(float(_LITERAL["size"][i]))))


_PATHS = (
    f"(CASE WHEN transactions_per_card < 3.5 THEN {_leaf(1)} WHEN users_per_card < 1.5 THEN {_leaf(3)} ELSE {_leaf(4)} END"
    f" + CASE WHEN users_per_card < 2.5 THEN {_leaf(6)} ELSE {_leaf(7)} END)"
)
_LITERAL_SCORE = f"-power(2.0, -{_PATHS} / 2 / {float(iforest.average_path(16.0))!r})"


def _counted_rows(spark, sf):
    rows = add_group_features(transactions(spark, sf), _ON)
    return rows.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in _ON])


@query("isolation_forest_literal", with_views(
    f"""SELECT id, user_id, CASE WHEN transactions_per_card IS NOT NULL AND users_per_card IS NOT NULL
    THEN {r6(_LITERAL_SCORE, 'x', 9).removesuffix(' AS x')} END AS anomaly_score FROM counted""", "tx", extra=_COUNTED))
def isolation_forest_literal(spark, sf):
    """Scores of a given forest; rows without a card have none."""
    model = iforest.ForestModel(_ON, 16, SEED, _LITERAL)
    return round_columns(iforest.isolation_forest_score(model, _counted_rows(spark, sf)), ["anomaly_score"], 9)


_WEIGHTS = [0.25, -0.5, 0.5, 0.125, 0.1, -0.2, 0.75, -0.25, 0.5, 1.0, 0.05, 0.3]


@query("autoencoder_literal", with_views(
    """SELECT id, user_id, round(((a - x) * (a - x) + (b - y) * (b - y)) / 2, 9) + 0.0 AS "Autoencoder_Error" FROM (
       SELECT *, h * 0.75 + k * 0.5 + 0.05 AS a, h * -0.25 + k * 1.0 + 0.3 AS b FROM (
       SELECT *, greatest(x * 0.25 + y * 0.5 + 0.1, 0) AS h, greatest(x * -0.5 + y * 0.125 - 0.2, 0) AS k FROM (
       SELECT id, user_id, transactions_per_card::double AS x, users_per_card::double AS y FROM counted)))""", "tx", extra=_COUNTED))
def autoencoder_literal(spark, sf):
    """Reconstruction error of every row under a given network; rows without a card have none."""
    model = ae.Autoencoder(_ON, ae.Network(hidden=(2,), output="linear"), np.array(_WEIGHTS), [])
    return round_columns(ae.autoencoder_error(model, _counted_rows(spark, sf)), ["Autoencoder_Error"], 9)
