"""Shop lookups, searches and listings."""

from pyspark.sql import functions as F

from fraudloom.functions import text
from fraudloom.operators import shop
from fraudloom.plans.oracle_views import with_views
from fraudloom.plans.registry import query
from fraudloom.sources import fixtures as fx

_DOUBLE_PRICE = "* REPLACE (cast(price AS double) AS price)"


def _products(spark, sf):
    return fx.shop_products(spark, sf).withColumn("price", F.col("price").cast("double"))


@query("product_list", with_views(f"SELECT {_DOUBLE_PRICE} FROM shop_products", "shop_products"))
def product_list(spark, sf):
    return shop.product_list(_products(spark, sf))


@query("product_lookup", with_views(
    f"SELECT {_DOUBLE_PRICE} FROM shop_products WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)",
    "shop_products"))
def product_lookup(spark, sf):
    keys = fx.table(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_partkey").alias("id"))
    return shop.product_lookup(_products(spark, sf), keys)


_TERMS = ["red", "wid", "Ring", "small ring"]
_ORDER_TERMS = ["customer#00000001", "red", "house 1", "Shop"]


def _search_sql(table, columns, terms, lowered, select):
    return " UNION ALL ".join(
        f"SELECT {select}, '{t}' AS term FROM {table} WHERE "
        + " OR ".join(f"contains(lower({c}), '{t.lower() if lowered else t}')" for c in columns) for t in terms)


@query("product_search", with_views(_search_sql("shop_products", ["name"], _TERMS, False, "id, name"), "shop_products"))
def product_search(spark, sf):
    return shop.product_search(_products(spark, sf), _TERMS).select("id", "name", "term")


@query("product_search_normalised",
       with_views(_search_sql("shop_products", ["name"], _TERMS, True, "id, name"), "shop_products"))
def product_search_normalised(spark, sf):
    return shop.product_search(_products(spark, sf), _TERMS, normalise_term=True).select("id", "name", "term")


@query("purchasable_products", with_views(
    "SELECT id, name, stock, CASE WHEN stock THEN 'Available' ELSE 'Out Of Stock!' END AS availability "
    "FROM shop_products", "shop_products"))
def purchasable_products(spark, sf):
    return shop.purchasable_products(_products(spark, sf)).select("id", "name", "stock", "availability")


_DEBTORS = "SELECT c_custkey FROM customer WHERE c_acctbal < 0"


def _debtors(spark, sf):
    return fx.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))


@query("cards_of_user", with_views(
    f"SELECT id, user_id, card_number, customer_id FROM tx WHERE user_id IN ({_DEBTORS})", "tx"))
def cards_of_user(spark, sf):
    cards = fx.transactions(spark, sf).select("id", "user_id", "card_number", "customer_id")
    return shop.cards_of_user(cards, _debtors(spark, sf))


@query("masked_cards", with_views(
    "SELECT id, user_id, 'XXXX XXXX XXXX ' || substr(card_number, 13, 6) AS card_number, "
    + ", ".join(f"coalesce(nullif({c}, ''), 'Not Set') AS {c}" for c in shop.CARD_FIELDS) + " FROM tx", "tx"))
def masked_cards(spark, sf):
    return shop.masked_cards(fx.transactions(spark, sf))


@query("addresses_of_user", with_views(
    f"SELECT * FROM shop_addresses WHERE user_id IN ({_DEBTORS})", "shop_addresses"))
def addresses_of_user(spark, sf):
    return shop.addresses_of_user(fx.shop_addresses(spark, sf), _debtors(spark, sf))


@query("address_lookup", with_views(
    "SELECT * FROM shop_addresses WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "shop_addresses"))
def address_lookup(spark, sf):
    keys = fx.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return shop.address_lookup(fx.shop_addresses(spark, sf), keys)


@query("user_profile", with_views(
    f"SELECT id, username, email, is_staff AS admin FROM shop_users WHERE id IN ({_DEBTORS})", "shop_users"))
def user_profile(spark, sf):
    return shop.user_profile(fx.shop_users(spark, sf), _debtors(spark, sf).withColumnRenamed("user_id", "id"))


_SEEN = "id, name, cast(total_price AS double) AS total_price, user_id"


@query("visible_orders", with_views(
    f"""SELECT 'staff' AS scope, cast(NULL AS bigint) AS viewer_id, {_SEEN} FROM shop_orders
    WHERE EXISTS (SELECT 1 FROM shop_users WHERE is_staff)
    UNION ALL SELECT 'own', user_id, {_SEEN} FROM shop_orders
    WHERE user_id IN (SELECT id FROM shop_users WHERE NOT is_staff AND id IN ({_DEBTORS}))""",
    "shop_orders", "shop_users"))
def visible_orders(spark, sf):
    users = fx.shop_users(spark, sf).select(F.col("id").alias("user_id"), "is_staff")
    debtors = shop.owned_by(users, _debtors(spark, sf)).filter("NOT is_staff")
    viewers = debtors.unionByName(users.filter("is_staff"))
    orders = fx.shop_orders(spark, sf).selectExpr(*[x.strip() for x in _SEEN.split(", ")])
    return shop.visible_orders(orders, viewers)


_ORDER_COLUMNS = ["name", "ordered_item", "address"]


@query("order_search", with_views(
    _search_sql("shop_orders", _ORDER_COLUMNS, _ORDER_TERMS, False, "id, name, ordered_item, address"), "shop_orders"))
def order_search(spark, sf):
    return shop.order_search(fx.shop_orders(spark, sf), _ORDER_TERMS).select("id", *_ORDER_COLUMNS, "term")


def _display_sql(c, spelling="Feburary"):
    months = dict(text.MONTHS, **{"02": spelling})
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in months.items())
    c = f"cast({c} AS varchar)"
    return f"substr({c}, 9, 2) || ' ' || CASE substr({c}, 6, 2) {cases} END || ' ' || substr({c}, 1, 4)"


@query("order_listing", with_views(
    f"""SELECT id, name, card_number, address, ordered_item, paid_status, {_display_sql('paid_at')} AS paid_on,
    cast(total_price AS varchar) || ' INR' AS amount, is_delivered, delivered_at,
    CASE WHEN is_delivered THEN 'Mark as Undelivered' ELSE 'Mark as delivered' END AS delivery_action
    FROM shop_orders""", "shop_orders"))
def order_listing(spark, sf):
    return shop.order_listing(fx.shop_orders(spark, sf))


@query("display_date", f"""SELECT o_orderkey AS id, {_display_sql('o_orderdate')} AS shown,
    {_display_sql('o_orderdate', 'February')} AS spelled FROM orders""")
def display_date(spark, sf):
    return fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), text.display_date("o_orderdate").alias("shown"),
        text.display_date("o_orderdate", correct_spelling=True).alias("spelled"),
    )


@query("format_address", with_views(
    """SELECT id, user_id, concat_ws(', ', house_no, 'near ' || landmark, city, state, pin_code) AS address,
    concat_ws(', ', house_no, landmark, city, state, pin_code) AS listed FROM shop_addresses""", "shop_addresses"))
def format_address(spark, sf):
    parts = ["house_no", "landmark", "city", "state", "pin_code"]
    return fx.shop_addresses(spark, sf).select(
        "id", "user_id", text.format_address(*parts).alias("address"),
        text.format_address(*parts, style="list").alias("listed"),
    )


def _admin(kind, view, load, cast=None):
    columns = shop.ADMIN_COLUMNS[kind]
    shown = [f"cast({c} AS {cast[c]}) AS {c}" if cast and c in cast else c for c in columns]

    @query(f"admin_listing_{kind}", with_views(f"SELECT {', '.join(shown)} FROM {view}", view))
    def run(spark, sf):
        df = shop.admin_listing(load(spark, sf), kind)
        return df.withColumns({c: F.col(c).cast(t.replace("varchar", "string")) for c, t in (cast or {}).items()})


_admin("card", "tx", fx.transactions)
_admin("address", "shop_addresses", fx.shop_addresses)
_admin("order", "shop_orders", fx.shop_orders, {"paid_at": "varchar", "total_price": "double"})
