"""Scans, profiles, cleaning and scalar expressions."""

from fraudloom.functions import text
from fraudloom.operators import clean, encode
from fraudloom.plans.oracle_views import NUM, SECOND, code, r6, scaled, with_views
from fraudloom.plans.registry import AS_OF, KEYS, query, round_columns
from fraudloom.schemas import CARD
from fraudloom.sources.fixtures import transactions

CARD_COLUMNS = CARD.fieldNames()
NUMERIC = ["user_id", "exp_month", "exp_year"]


@query("scan_transactions_table", with_views(f"SELECT {', '.join(CARD_COLUMNS)} FROM tx", "tx"))
def scan_transactions_table(spark, sf):
    return transactions(spark, sf).select(*CARD_COLUMNS)


_PARSED = "SELECT id, user_id, try_cast(exp_month AS double) AS exp_month, try_cast(exp_year AS double) AS exp_year FROM tx"


def _profile_sql(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null,
    {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, cast(min({c}) AS double) AS min,
    {r6(f'quantile_cont(cast({c} AS double), 0.25)', 'q25')}, {r6(f'quantile_cont(cast({c} AS double), 0.5)', 'q50')},
    {r6(f'quantile_cont(cast({c} AS double), 0.75)', 'q75')}, cast(max({c}) AS double) AS max FROM p"""


@query("profile_columns", with_views(" UNION ALL ".join(map(_profile_sql, NUMERIC)), "tx", extra={"p": _PARSED}))
def profile_columns(spark, sf):
    df = transactions(spark, sf).select(
        "user_id", text.to_number("exp_month").alias("exp_month"), text.to_number("exp_year").alias("exp_year")
    )
    return round_columns(clean.profile_columns(df, NUMERIC), ["mean", "std", "q25", "q50", "q75"])


@query(
    "fill_missing",
    with_views(
        "SELECT id, user_id, coalesce(address_country, 'Unknown') AS address_country, "
        "coalesce(address_state, 'Unknown') AS address_state, coalesce(email, 'unknown@unknown.com') AS email FROM tx",
        "tx",
    ),
)
def fill_missing(spark, sf):
    return clean.fill_missing(transactions(spark, sf)).select(*KEYS, "address_country", "address_state", "email")


@query("fill_categories", with_views(
    "SELECT id, user_id, coalesce(address_state, 'unknown') AS address_state, "
    "coalesce(card_number, 'unknown') AS card_number FROM tx", "tx"))
def fill_categories(spark, sf):
    columns = ["address_state", "card_number"]
    return clean.fill_categories(transactions(spark, sf), columns).select(*KEYS, *columns)


def _domain(name, sql, fn):
    @query(name, with_views(f"SELECT id, user_id, {sql} AS email_domain FROM tx", "tx"))
    def run(spark, sf):
        return transactions(spark, sf).select(*KEYS, fn("email").alias("email_domain"))


_domain("email_domain_second", SECOND, text.email_domain_second)
_domain("email_domain_last", "split_part(email, '@', -1)", text.email_domain_last)
_domain("email_domain_guarded", f"coalesce({SECOND}, 'unknown')", text.email_domain_guarded)

_MONTH, _YEAR = NUM.format(c="exp_month", d=1), NUM.format(c="exp_year", d=2024)


@query("parse_expiry", with_views(f"SELECT id, user_id, {_MONTH} AS exp_month, {_YEAR} AS exp_year FROM tx", "tx"))
def parse_expiry(spark, sf):
    return transactions(spark, sf).select(
        *KEYS, text.to_number("exp_month", 1).alias("exp_month"), text.to_number("exp_year", 2024).alias("exp_year")
    )


@query("card_expiry_months", with_views(
    f"SELECT id, user_id, ({_YEAR} - {AS_OF.year}) * 12 + {_MONTH} AS card_expiry_months FROM tx", "tx"))
def card_expiry_months(spark, sf):
    return parse_expiry(spark, sf).select(
        *KEYS, text.card_expiry_months("exp_month", "exp_year", AS_OF.year).alias("card_expiry_months")
    )


@query("months_to_expiry", with_views(
    f"SELECT id, user_id, ({_YEAR} - {AS_OF.year}) * 12 + {_MONTH} - {AS_OF.month} AS months_to_expiry FROM tx", "tx"))
def months_to_expiry(spark, sf):
    left = text.months_to_expiry("exp_month", "exp_year", AS_OF.year, AS_OF.month)
    return parse_expiry(spark, sf).select(*KEYS, left.alias("months_to_expiry"))


_IDENTIFIERS = ["card_id", "customer_id", "email", "name_on_card", "card_number", "no_such_column"]


@query("drop_identifiers", with_views(
    "SELECT id, user_id, exp_month, exp_year, address_city, address_country, address_state, address_zip FROM tx", "tx"))
def drop_identifiers(spark, sf):
    return clean.drop_identifiers(transactions(spark, sf), _IDENTIFIERS)


@query("select_features", with_views("SELECT id, address_state, exp_month, exp_year FROM tx", "tx"))
def select_features(spark, sf):
    return clean.select_features(
        transactions(spark, sf), ["id", "card_user_count", "address_state", "exp_month", "exp_year"]
    )


_CODED = ["address_country", "address_state", "address_zip", "card_number"]


@query("encode_categories", with_views(
    "SELECT id, user_id, " + ", ".join(f"{c}_m.code AS {c}" for c in _CODED) + " FROM tx "
    + " ".join(f"LEFT JOIN {code('tx', c)} {c}_m ON tx.{c} = {c}_m.v" for c in _CODED), "tx"))
def encode_categories(spark, sf):
    df = transactions(spark, sf).select(*KEYS, *_CODED)
    return encode.apply_codes(df, encode.fit_codes(df, _CODED), _CODED, KEYS)


_HOLED = ["address_state", "card_number", "exp_year"]


def _mode_sql(c):
    return f"(SELECT {c} FROM tx WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_most_frequent", with_views(
    "SELECT id, user_id, " + ", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in _HOLED) + " FROM tx", "tx"))
def impute_most_frequent(spark, sf):
    df = transactions(spark, sf).select(*KEYS, *_HOLED)
    return clean.impute(df, clean.fit_most_frequent(df, _HOLED))


_DATES = ["exp_month", "exp_year"]


def _dates(spark, sf):
    return transactions(spark, sf).select(*KEYS, *[text.to_number(c).alias(c) for c in _DATES])


@query("impute_mean", with_views(
    "SELECT id, user_id, " + ", ".join(r6(f"coalesce({c}, avg({c}) OVER ())", c) for c in _DATES) + " FROM p",
    "tx", extra={"p": _PARSED}))
def impute_mean(spark, sf):
    df = _dates(spark, sf)
    return round_columns(clean.impute(df, clean.fit_mean(df, _DATES)), _DATES)


@query("standardize", with_views(
    f"SELECT id, user_id, {', '.join(r6(c) for c in _DATES)} FROM s",
    "tx", extra={"p": _PARSED, "s": scaled("p", _DATES)}))
def standardize(spark, sf):
    df = _dates(spark, sf)
    return round_columns(clean.standardize(df, clean.fit_scale(df, _DATES)), _DATES)


@query("drop_incomplete", with_views(
    "SELECT * FROM p WHERE exp_month IS NOT NULL AND exp_year IS NOT NULL", "tx", extra={"p": _PARSED}))
def drop_incomplete(spark, sf):
    return clean.drop_incomplete(_dates(spark, sf), _DATES)
