"""Group counts and the composed feature sets."""

from fraudloom.functions import text
from fraudloom.operators import clean, feature_sets
from fraudloom.operators.group_features import FEATURES, add_group_features
from fraudloom.plans.oracle_views import FILLED, GUARDED, NUM, code, grouped, r6, scaled, with_views
from fraudloom.plans.registry import AS_OF, KEYS, query, round_columns
from fraudloom.sources.fixtures import transactions

_RAW = [
    "transactions_per_card", "transactions_per_customer", "transactions_per_state", "transactions_per_zip",
    "users_per_card", "addresses_per_card", "cards_per_customer", "cards_per_user",
    "card_user_count", "customer_id_count",
]
_WHEN_FILLED = ["country_freq", "state_freq", "multiple_states", "multiple_countries"]


def _aggregate(name):
    m = FEATURES[name]
    return {
        "count": f"count({m.value})",
        "distinct": f"count(DISTINCT {m.value})",
        "many": f"count(DISTINCT {m.value}) > 1",
    }[m.fn]


def _measures(names):
    return [(n, FEATURES[n].key, _aggregate(n)) for n in names]


def _shown(name):
    return f"coalesce({name}, false) AS {name}" if FEATURES[name].fn == "many" else name


def _register(name, source, prepare):
    sql = with_views(
        f"SELECT id, user_id, {_shown(name)} FROM g", "tx",
        extra={"f": source, "g": grouped("f", _measures([name]))},
    )

    @query(name, sql)
    def run(spark, sf):
        return add_group_features(prepare(transactions(spark, sf)), [name]).select(*KEYS, name)


for _name in _RAW:
    _register(_name, "SELECT * FROM tx", lambda df: df)
for _name in _WHEN_FILLED:
    _register(_name, FILLED, clean.fill_missing)
_register("email_domain_freq", GUARDED, lambda df: df.withColumn("email_domain", text.email_domain_guarded("email")))


_MONTH, _YEAR = NUM.format(c="exp_month", d=1), NUM.format(c="exp_year", d=2024)
_DATED = f"SELECT * REPLACE ({_MONTH} AS exp_month, {_YEAR} AS exp_year) FROM "


def _coded(source, columns, others):
    picked = [f"m_{c}.code AS {c}" for c in columns] + others
    joins = " ".join(f"LEFT JOIN {code(source, c)} m_{c} ON {source}.{c} = m_{c}.v" for c in columns)
    return f"SELECT id, user_id, {', '.join(picked)} FROM {source} {joins}"


def comparison_ctes(spec):
    """CTEs ending in ``features``: unscaled comparison features."""
    return {
        "f": FILLED,
        "d": _DATED + "f",
        "g": grouped("d", _measures(spec.counts)),
        "features": _coded(
            "g",
            list(spec.codes),
            [
                f"cast(coalesce({c}, false) AS int) AS {c}" if c in FEATURES and FEATURES[c].fn == "many" else c
                for c in spec.columns if c not in spec.codes
            ],
        ),
    }


def _doubles(columns):
    return ", ".join(f"cast({c} AS double) AS {c}" for c in columns)


def _comparison(name, spec):
    sql = with_views(f"SELECT id, user_id, {_doubles(spec.columns)} FROM features", "tx", extra=comparison_ctes(spec))

    @query(name, sql)
    def run(spark, sf):
        df = transactions(spark, sf)
        return feature_sets.fit_tables(df, spec, AS_OF).raw(df)


_comparison("features_comparison12", feature_sets.COMPARISON12)
_comparison("features_comparison10", feature_sets.COMPARISON10)

_S12 = feature_sets.COMPARISON12.columns


@query("feature_stats", with_views(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg({c})', 'mean')}, {r6(f'stddev_pop({c})', 'std')}, "
        f"{r6(f'min({c})', 'min')}, {r6(f'max({c})', 'max')} FROM s" for c in _S12),
    "tx", extra={**comparison_ctes(feature_sets.COMPARISON12), "s": scaled("features", _S12)}))
def feature_stats(spark, sf):
    model, raw = feature_sets.fit(transactions(spark, sf), feature_sets.COMPARISON12, AS_OF)
    return round_columns(clean.feature_stats(model.finish(raw), model.features), ["mean", "std", "min", "max"])


def _scaled_set(name, spec, ctes, imputed):
    names = [f"f_{c}" if c in KEYS else c for c in spec.columns]
    sql = with_views(
        f"SELECT id, user_id, {', '.join(r6(c) for c in names)} FROM s", "tx",
        extra={**ctes, "i": imputed(names), "s": scaled("i", names)},
    )

    @query(name, sql)
    def run(spark, sf):
        model, raw = feature_sets.fit(transactions(spark, sf), spec, AS_OF)
        return round_columns(model.finish(raw), model.features)


def _impute_sql(fill):
    return lambda names: f"SELECT id, user_id, {', '.join(f'coalesce({c}, {fill(c)}) AS {c}' for c in names)} FROM features"


def _label(columns, missing):
    return ", ".join(f"coalesce({c}, '{missing}') AS {c}" for c in columns)


_F, _A, _C = feature_sets.FOREST, feature_sets.AUTOENCODER, feature_sets.CLUSTER
_scaled_set(
    "features_forest", _F,
    {
        "f": GUARDED,
        "d": f"SELECT *, (exp_year - {AS_OF.year}) * 12 + exp_month AS card_expiry_months FROM ({_DATED} f)",
        "g": grouped("d", _measures(_F.counts)),
        "l": f"SELECT * REPLACE ({_label(_F.codes, 'unknown')}) FROM g",
        "features": _coded(
            "l", list(_F.codes),
            ["user_id AS f_user_id"] + [c for c in _F.columns if c not in _F.codes and c != "user_id"]),
    },
    _impute_sql(lambda c: f"(SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"),
)
_scaled_set(
    "features_autoencoder", _A,
    {
        "d": f"SELECT *, (exp_year - {AS_OF.year}) * 12 + exp_month - {AS_OF.month} AS months_to_expiry FROM ({_DATED} tx)",
        "g": grouped("d", _measures(_A.counts)),
        "l": f"SELECT * REPLACE ({_label(_A.codes, 'None')}) FROM g",
        "features": _coded("l", list(_A.codes), [c for c in _A.columns if c not in _A.codes]),
    },
    _impute_sql(lambda c: f"avg({c}) OVER ()"),
)
CLUSTER_CTES = {
    "d": "SELECT * REPLACE (try_cast(exp_month AS double) AS exp_month, try_cast(exp_year AS double) AS exp_year) FROM tx",
    "g": grouped("d", _measures(_C.counts)),
    "features": _coded("g", list(_C.codes), [c for c in _C.columns if c not in _C.codes]),
}
_scaled_set("features_cluster", _C, CLUSTER_CTES, _impute_sql(lambda c: "NULL"))
