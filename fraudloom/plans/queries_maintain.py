"""Validation and batch maintenance of the shop tables."""

from datetime import datetime

from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import maintain, validate
from fraudloom.plans.oracle_views import with_views
from fraudloom.plans.queries_shop import _display_sql
from fraudloom.plans.registry import AS_OF, query
from fraudloom.sources import fixtures as fx

M = maintain


def sets(spark, sf, sql, *names):
    """A change set written in SQL that both engines read alike."""
    return spark.sql(sql.replace("varchar", "string"), **{n: fx.table(spark, sf, n) for n in names})


def braces(sql, *names):
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return sql


def _load(sql, *names):
    return lambda spark, sf: sets(spark, sf, braces(sql, *names), *names)


def verdicts(pair, key="request_id"):
    accepted, rejects = pair
    return accepted.select(key, F.lit(None).cast("string").alias("reason")).unionByName(rejects.select(key, "reason"))


# ---- validation

_NEW_PRODUCTS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 13 = 0 THEN 'abc' WHEN p_partkey % 17 = 0 THEN '1234567.89'
       WHEN p_partkey % 19 = 0 THEN '12.345' ELSE cast(cast(p_retailprice AS decimal(8,2)) AS varchar) END AS price,
  CASE WHEN p_partkey % 7 = 0 THEN 'maybe' WHEN p_partkey % 2 = 0 THEN 'True' ELSE '0' END AS stock FROM part"""
_products = _load(_NEW_PRODUCTS, "part")


@query("validate_products", f"""SELECT id, CASE WHEN trim(name) = '' THEN 'name: required'
    WHEN NOT (regexp_full_match(price, '[+-]?\\d{{0,6}}(\\.\\d{{0,2}})?') AND try_cast(price AS decimal(8,2)) IS NOT NULL)
    THEN 'price: not a decimal of 8 digits' WHEN lower(stock) NOT IN ('true', '0') THEN 'stock: not a boolean' END
    AS reason FROM ({_NEW_PRODUCTS})""")
def validate_products(spark, sf):
    return verdicts(validate.validate_products(_products(spark, sf)), "id")


@query("validate_addresses", with_views(
    """SELECT id, CASE WHEN NOT regexp_full_match(phone_number, '\\+?1?\\d{9,15}') AND length(phone_number) <= 10
    THEN 'phone_number: bad format' WHEN length(phone_number) > 10 THEN 'phone_number: longer than 10'
    WHEN length(pin_code) > 6 THEN 'pin_code: longer than 6' END AS reason FROM shop_addresses""", "shop_addresses"))
def validate_addresses(spark, sf):
    return verdicts(validate.validate_addresses(fx.shop_addresses(spark, sf)), "id")


@query("validate_cards", with_views(
    """SELECT id, CASE WHEN length(card_number) > 20 THEN 'card_number: longer than 20'
    WHEN length(exp_month) > 2 THEN 'exp_month: longer than 2'
    WHEN NOT regexp_full_match(exp_month, '\\d{0,9}') THEN 'exp_month: bad format'
    WHEN NOT regexp_full_match(exp_year, '\\d{0,9}') THEN 'exp_year: bad format' END AS reason FROM tx""", "tx"))
def validate_cards(spark, sf):
    return verdicts(validate.validate_cards(fx.transactions(spark, sf)), "id")


@query("validate_form_rules", with_views(
    f"""SELECT id, unnest(list_filter([
      CASE WHEN email <> '' AND NOT regexp_full_match(email, '.+@gmail\\.com') THEN 'email: bad format' END,
      CASE WHEN card_number IS NULL THEN 'card_number: required' END,
      CASE WHEN length(card_number) > 16 THEN 'card_number: longer than 16' END,
      CASE WHEN cvc IS NULL OR cvc = '' THEN 'cvc: required' END,
      CASE WHEN length(cvc) > 3 THEN 'cvc: longer than 3' END,
      CASE WHEN exp_month IS NULL THEN 'exp_month: required' END,
      CASE WHEN exp_month IS NOT NULL AND NOT coalesce(try_cast(exp_month AS double) BETWEEN 1 AND 12, false)
           THEN 'exp_month: out of range' END,
      CASE WHEN exp_year IS NULL THEN 'exp_year: required' END,
      CASE WHEN exp_year IS NOT NULL AND NOT coalesce(try_cast(exp_year AS double) BETWEEN {AS_OF.year} AND
           {AS_OF.year + 20}, false) THEN 'exp_year: out of range' END], lambda x: x IS NOT NULL)) AS reason
    FROM (SELECT *, CASE WHEN id % 43 = 0 THEN '' ELSE cast(id % 1200 AS varchar) END AS cvc FROM tx)""", "tx"))
def validate_form_rules(spark, sf):
    cvc = F.when(F.col("id") % 43 == 0, "").otherwise((F.col("id") % 1200).cast("string"))
    return validate.validate_form_rules(fx.transactions(spark, sf).withColumn("cvc", cvc), "card", AS_OF.year)


# ---- requests on cards, users, addresses and orders

_REQUESTS = """SELECT o_orderkey AS request_id, o_custkey AS requester_id,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 29 = 0 THEN NULL
       ELSE concat('user', cast(o_custkey % 700 AS varchar), '@shop.example.com') END AS email,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE concat('4', lpad(cast(o_custkey * 7 AS varchar), 15, '0')) END AS card_number,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(o_custkey % 12 + 1 AS varchar) END AS exp_month,
  cast(2023 + o_custkey % 11 AS varchar) AS exp_year, cast(o_orderkey % 1000 AS varchar) AS cvc,
  concat('cus_', cast(o_custkey AS varchar)) AS customer_id, concat('card_', cast(o_orderkey AS varchar)) AS card_id,
  o_custkey AS user_id, o_orderkey % 4 <> 0 AS save_card FROM orders"""
_requests = _load(_REQUESTS, "orders")

_NUM = "try_cast(nullif({0}, '') AS double) AS {0}"


@query("normalise_card_requests", with_views(
    f"""SELECT request_id, coalesce(nullif(r.email, ''), u.email) AS email, {_NUM.format('exp_month')},
    {_NUM.format('exp_year')}, {_NUM.format('cvc')} FROM ({_REQUESTS}) r LEFT JOIN shop_users u ON u.id = requester_id""",
    "shop_users"))
def normalise_card_requests(spark, sf):
    df = M.normalise_card_requests(_requests(spark, sf), fx.shop_users(spark, sf))
    return df.select("request_id", "email", "exp_month", "exp_year", "cvc")


@query("blank_to_null", f"""SELECT request_id, nullif(email, '') AS email, nullif(exp_month, '') AS exp_month
    FROM ({_REQUESTS})""")
def blank_to_null(spark, sf):
    df = M.blank_to_null(_requests(spark, sf), ["email", "exp_month"])
    return df.select("request_id", "email", "exp_month")


_CHANGES = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey + 1000000000
       ELSE o_custkey END AS id, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS requester_id,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Town ', cast(o_orderkey % 50 AS varchar)) END AS city,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lpad(cast(o_orderkey % 999 AS varchar), 6, '0') END AS pin_code,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('name', cast(o_orderkey AS varchar)) END AS username,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('mail', cast(o_orderkey AS varchar), '@example.com') END AS email,
  o_orderkey % 2 = 0 AS flag FROM orders"""
_changes = _load(_CHANGES, "orders")
_LAST = f"(SELECT * FROM ({_CHANGES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)"


@query("apply_updates_keep_blank", with_views(
    f"""SELECT a.* REPLACE (coalesce(nullif(c.city, ''), a.city) AS city,
    coalesce(nullif(c.pin_code, ''), a.pin_code) AS pin_code) FROM shop_addresses a LEFT JOIN {_LAST} c ON c.id = a.id""",
    "shop_addresses"))
def apply_updates_keep_blank(spark, sf):
    changes = _changes(spark, sf).select("request_id", "id", "city", "pin_code")
    return M.apply_updates_keep_blank(fx.shop_addresses(spark, sf), changes, ["city", "pin_code"])


@query("apply_updates_products", with_views(
    f"""SELECT p.id, p.name, cast(coalesce(try_cast(c.pin_code AS decimal(8,2)), p.price) AS double) AS price,
    CASE WHEN c.id IS NULL THEN p.stock ELSE c.flag END AS stock FROM shop_products p LEFT JOIN {_LAST} c ON c.id = p.id""",
    "shop_products"))
def apply_updates_products(spark, sf):
    changes = _changes(spark, sf).select("request_id", "id", F.col("pin_code").alias("price"), F.col("flag").alias("stock"))
    products = fx.shop_products(spark, sf).select("id", "name", "price", "stock")
    df = M.apply_updates_keep_blank(products, changes, ["price"], always=["stock"])
    return df.withColumn("price", F.col("price").cast("double"))


def _user_updates(name, blank, expr):
    @query(name, with_views(
        f"""SELECT u.id, {expr.format('username')} AS username, {expr.format('email')} AS email, is_staff
        FROM shop_users u LEFT JOIN {_LAST} c ON c.id = u.id""", "shop_users"))
    def run(spark, sf):
        changes = _changes(spark, sf).select("request_id", "id", "username", "email")
        return M.apply_user_updates(fx.shop_users(spark, sf), changes, blank)


_user_updates("apply_user_updates", "overwrite", "CASE WHEN c.id IS NULL THEN u.{0} ELSE c.{0} END")
_user_updates("apply_user_updates_form", "keep", "coalesce(nullif(c.{0}, ''), u.{0})")


@query("owned_changes_only", with_views(
    f"""SELECT request_id, CASE WHEN a.id IS NULL THEN '{M.NOT_FOUND}' WHEN a.user_id <> requester_id
    THEN '{M.DENIED}' END AS reason FROM ({_CHANGES}) c LEFT JOIN shop_addresses a ON a.id = c.id""", "shop_addresses"))
def owned_changes_only(spark, sf):
    return verdicts(M.owned_changes_only(fx.shop_addresses(spark, sf), _changes(spark, sf)))


@query("admin_changes_only", with_views(
    f"""SELECT request_id, CASE WHEN NOT coalesce(u.is_staff, false) THEN '{M.DENIED}' END AS reason
    FROM ({_CHANGES}) c LEFT JOIN shop_users u ON u.id = requester_id""", "shop_users"))
def admin_changes_only(spark, sf):
    return verdicts(M.admin_changes_only(_changes(spark, sf), fx.shop_users(spark, sf)))


@query("delete_by_key", with_views(
    f"SELECT * FROM shop_addresses WHERE id NOT IN (SELECT id FROM ({_CHANGES}) WHERE flag)", "shop_addresses"))
def delete_by_key(spark, sf):
    return M.delete_by_key(fx.shop_addresses(spark, sf), _changes(spark, sf).filter("flag"))


_GONE = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query("delete_users_cascade", with_views(
    f"""SELECT 'user' AS kind, id FROM shop_users WHERE id NOT IN {_GONE}
    UNION ALL SELECT 'card', id FROM tx WHERE user_id IS NULL OR user_id NOT IN {_GONE}
    UNION ALL SELECT 'address', id FROM shop_addresses WHERE user_id IS NULL OR user_id NOT IN {_GONE}
    UNION ALL SELECT 'order', id FROM shop_orders WHERE user_id IS NULL OR user_id NOT IN {_GONE}""",
    "tx", "shop_users", "shop_addresses", "shop_orders"))
def delete_users_cascade(spark, sf):
    gone = fx.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    children = {
        "card": fx.transactions(spark, sf), "address": fx.shop_addresses(spark, sf), "order": fx.shop_orders(spark, sf),
    }
    users, kept = M.delete_users_cascade(fx.shop_users(spark, sf), children, gone)
    out = users.select(F.lit("user").alias("kind"), "id")
    for kind, child in kept.items():
        out = out.unionByName(child.select(F.lit(kind).alias("kind"), "id"))
    return out


_REGISTER = """SELECT o_orderkey AS request_id,
  CASE WHEN o_orderkey % 31 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN concat('Customer#', lpad(cast(o_custkey AS varchar), 9, '0'))
       ELSE concat('new', cast(o_custkey AS varchar)) END AS username,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat('user', cast(o_custkey AS varchar), '@machinery.example.com')
       WHEN o_orderkey % 3 = 0 THEN concat('pair', cast(o_custkey - o_custkey % 2 AS varchar), '@example.com')
       ELSE concat('own', cast(o_custkey AS varchar), '@example.com') END AS email FROM orders"""
_registrations = _load(_REGISTER, "orders")


def _round(i):
    return f""",
    lead{i} AS (SELECT * FROM open{i} WHERE request_id = first_u AND request_id = first_e),
    open{i + 1} AS (SELECT request_id, username, email, min(request_id) OVER (PARTITION BY username) AS first_u,
       min(request_id) OVER (PARTITION BY email) AS first_e FROM open{i}
       WHERE username NOT IN (SELECT username FROM lead{i}) AND email NOT IN (SELECT email FROM lead{i}))"""


@query("register_users", with_views("", "shop_users").rstrip()
    + f""", r AS ({_REGISTER}),
    early AS (SELECT *, CASE WHEN coalesce(username, '') = '' OR coalesce(email, '') = '' THEN '{M.BLANK_USER}'
       WHEN username IN (SELECT username FROM shop_users) THEN '{M.USERNAME_TAKEN}'
       WHEN email IN (SELECT email FROM shop_users) THEN '{M.EMAIL_TAKEN}' END AS reason FROM r),
    open0 AS (SELECT request_id, username, email, min(request_id) OVER (PARTITION BY username) AS first_u,
       min(request_id) OVER (PARTITION BY email) AS first_e FROM early WHERE reason IS NULL)"""
    + "".join(_round(i) for i in range(6))
    + ", taken AS (" + " UNION ALL ".join(f"SELECT request_id, username FROM lead{i}" for i in range(6)) + ")"
    + f""" SELECT e.request_id, CASE WHEN e.reason <> '{M.EMAIL_TAKEN}' THEN e.reason
       WHEN e.request_id IN (SELECT request_id FROM taken) THEN NULL
       WHEN t.request_id < e.request_id THEN '{M.USERNAME_TAKEN}' ELSE '{M.EMAIL_TAKEN}' END AS reason
    FROM early e LEFT JOIN taken t ON t.username = e.username""")
def register_users(spark, sf):
    return verdicts(M.register_users(fx.shop_users(spark, sf), _registrations(spark, sf)))


@query("save_cards", with_views(
    f"""SELECT request_id, CASE WHEN card_number IS NOT NULL AND (card_number IN (SELECT card_number FROM tx
    WHERE card_number IS NOT NULL) OR row_number() OVER (PARTITION BY card_number ORDER BY request_id) > 1)
    THEN '{M.CARD_IN_USE}' END AS reason FROM ({_REQUESTS}) WHERE save_card""", "tx"))
def save_cards(spark, sf):
    return verdicts(M.save_cards(fx.transactions(spark, sf), _requests(spark, sf)))


_KNOWN = """SELECT right(lpad(cast(c_custkey * 7 AS varchar), 15, '0'), 4) AS last4,
  CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE concat('user', cast(c_custkey % 700 AS varchar), '@shop.example.com') END AS email,
  cast(c_custkey % 12 + 1 AS varchar) AS exp_month, cast(2023 + c_custkey % 11 AS varchar) AS exp_year,
  c_custkey AS created FROM customer"""
_known = _load(_KNOWN, "customer")


@query("card_email_mismatch", f"""SELECT request_id, CASE WHEN EXISTS (SELECT 1 FROM ({_KNOWN}) k
    WHERE k.last4 = substr(r.card_number, 13, 4) AND k.email IS DISTINCT FROM r.email) THEN '{M.EMAIL_MISMATCH}' END
    AS reason FROM ({_REQUESTS}) r""")
def card_email_mismatch(spark, sf):
    return verdicts(M.card_email_mismatch(_requests(spark, sf), _known(spark, sf).select("last4", "email")))


@query("card_details_mismatch", f"""SELECT request_id, CASE WHEN k.email IS NOT NULL AND NOT (
    k.last4 IS NOT DISTINCT FROM right(r.card_number, 4) AND k.exp_month IS NOT DISTINCT FROM r.exp_month
    AND k.exp_year IS NOT DISTINCT FROM r.exp_year) THEN '{M.CARD_MISMATCH}' END AS reason FROM ({_REQUESTS}) r
    LEFT JOIN (SELECT * FROM ({_KNOWN}) QUALIFY row_number() OVER (PARTITION BY email ORDER BY created DESC) = 1) k
    ON k.email = r.email""")
def card_details_mismatch(spark, sf):
    return verdicts(M.card_details_mismatch(_requests(spark, sf), _known(spark, sf)))


_PAID_AT = datetime(2024, 6, 15, 12, 30)
_CHARGES = """SELECT l_orderkey AS request_id, min(l_partkey) AS product_id FROM lineitem GROUP BY l_orderkey"""


@query("append_orders", with_views(
    f"""SELECT request_id, a.name, p.name AS ordered_item, right(r.card_number, 4) AS card_number,
    concat_ws(', ', house_no, 'near ' || landmark, city, state, pin_code) AS address, true AS paid_status,
    '2024-06-15 12:30:00' AS paid_at, cast(price AS double) AS total_price, false AS is_delivered,
    'Not Delivered' AS delivered_at, r.user_id, cast(trunc(cast(price AS double) * 100) AS bigint) AS charged_minor_units
    FROM ({_REQUESTS}) r JOIN ({_CHARGES}) c USING (request_id) JOIN shop_products p ON p.id = c.product_id
    JOIN shop_addresses a ON a.id = r.requester_id""", "shop_products", "shop_addresses"))
def append_orders(spark, sf):
    first = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.min("l_partkey").alias("product_id")
    )
    charges = _requests(spark, sf).select(
        "request_id", "user_id", "card_number", F.col("requester_id").alias("address_id")
    ).join(first, "request_id")
    df = M.append_orders(charges, fx.shop_products(spark, sf), fx.shop_addresses(spark, sf), _PAID_AT)
    return df.withColumn("total_price", F.col("total_price").cast("double")).withColumn(
        "paid_at", F.col("paid_at").cast("string")
    )


@query("minor_units", """SELECT o_orderkey AS id, cast(trunc(o_totalprice * 100) AS bigint) AS truncated,
    cast(cast(o_totalprice AS decimal(18,2)) * 100 AS bigint) AS exact FROM orders""")
def minor_units(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), text.minor_units("o_totalprice").alias("truncated"),
        text.minor_units("o_totalprice", exact=True).alias("exact"),
    )


# line items may tie on everything but the flag, so the flag ends the order
_STEP = "(l_linenumber * 1000000 + l_partkey) * 10 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"


@query("set_delivery_status", with_views(
    f"""SELECT o.id, coalesce(c.is_delivered, o.is_delivered) AS is_delivered, CASE WHEN c.id IS NULL THEN o.delivered_at
    WHEN c.is_delivered THEN {_display_sql("'2024-06-15'")} ELSE 'Not Delivered' END AS delivered_at
    FROM shop_orders o LEFT JOIN (SELECT l_orderkey AS id, max_by(l_returnflag = 'R', {_STEP})
    AS is_delivered FROM lineitem GROUP BY 1) c ON c.id = o.id""", "shop_orders"))
def set_delivery_status(spark, sf):
    changes = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", f"{_STEP} AS request_id", "l_returnflag = 'R' AS is_delivered"
    )
    orders = fx.shop_orders(spark, sf).select("id", "is_delivered", "delivered_at")
    return M.set_delivery_status(orders, changes, "2024-06-15")


@query("apply_updates_cards", with_views(
    """SELECT t.id, t.user_id, t.card_number, coalesce(nullif(c.exp_month, ''), t.exp_month) AS exp_month,
    coalesce(nullif(c.name_on_card, ''), t.name_on_card) AS name_on_card FROM tx t LEFT JOIN (
      SELECT card_number, max_by(exp_month, request_id) AS exp_month, max_by(name_on_card, request_id) AS name_on_card
      FROM (SELECT card_number, id AS request_id, CASE WHEN id % 3 = 0 THEN '' ELSE '11' END AS exp_month,
            CASE WHEN id % 2 = 0 THEN '' ELSE upper(name_on_card) END AS name_on_card
            FROM tx WHERE id % 7 = 0 AND card_number IS NOT NULL) GROUP BY card_number) c
    ON c.card_number = t.card_number""", "tx"))
def apply_updates_cards(spark, sf):
    """Cards are found by their number; the last request of a card wins whole, and its blanks keep the old."""
    cards = fx.transactions(spark, sf)
    changes = cards.filter("id % 7 = 0 AND card_number IS NOT NULL").selectExpr(
        "card_number", "id AS request_id", "CASE WHEN id % 3 = 0 THEN '' ELSE '11' END AS exp_month",
        "CASE WHEN id % 2 = 0 THEN '' ELSE upper(name_on_card) END AS name_on_card",
    )
    base = cards.select("id", "user_id", "card_number", "exp_month", "name_on_card")
    return M.apply_updates_keep_blank(base, changes, ["exp_month", "name_on_card"], key="card_number")
