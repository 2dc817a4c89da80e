"""Shop lookups and listings, for many users, keys or terms at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudloom.functions import text

# The columns each listing shows.
PRODUCT_COLUMNS = ["id", "name", "description", "price", "stock", "image"]
ADMIN_COLUMNS = {
    "card": ["id", "email", "card_number", "user_id", "exp_month", "exp_year", "customer_id", "card_id"],
    "address": ["id", "name", "user_id", "phone_number", "pin_code", "house_no", "landmark", "city", "state"],
    "order": [
        "id", "name", "card_number", "address", "ordered_item", "paid_status", "paid_at", "total_price",
        "is_delivered", "delivered_at", "user_id",
    ],
}
CARD_FIELDS = [
    "name_on_card", "exp_month", "exp_year", "address_city", "address_country", "address_state", "address_zip",
]


def product_list(products: DataFrame) -> DataFrame:
    return products.select(*PRODUCT_COLUMNS)


def lookup(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is asked for."""
    return table.join(keys.select(key), key, "left_semi")


product_lookup = lookup
address_lookup = lookup


def _hits(columns: list[str], terms: list[str], normalise_term: bool) -> Column:
    """The terms found in any of the lowered columns."""
    found = []
    for term in terms:
        needle = term.lower() if normalise_term else term
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        found.append(F.when(hit, F.lit(term)))
    return F.array_compact(F.array(*found))


def search(table: DataFrame, columns: list[str], terms: list[str], normalise_term: bool = False) -> DataFrame:
    """One row per term and matching row, in a single scan.

    The columns are lowered; the terms only with ``normalise_term``, so a term
    with capitals matches nothing by default. A blank term matches every row.
    """
    hits = _hits(columns, list(dict.fromkeys(terms)), normalise_term)
    return table.withColumn("term", F.explode(hits))


def product_search(products: DataFrame, terms: list[str], normalise_term: bool = False) -> DataFrame:
    return search(products, ["name"], terms, normalise_term)


def order_search(orders: DataFrame, terms: list[str], normalise_term: bool = False) -> DataFrame:
    return search(orders, ["name", "ordered_item", "address"], terms, normalise_term)


def purchasable_products(products: DataFrame) -> DataFrame:
    state = F.when(F.col("stock"), "Available").otherwise("Out Of Stock!")
    return products.withColumn("availability", state)


def owned_by(table: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of ``table`` owned by the given users (a column ``user_id``)."""
    return table.join(users.select(F.col("user_id").alias(user)), user, "left_semi")


cards_of_user = owned_by
addresses_of_user = owned_by


def masked_cards(cards: DataFrame) -> DataFrame:
    return cards.select(
        "id", "user_id", text.mask_card("card_number").alias("card_number"),
        *[text.or_not_set(c).alias(c) for c in CARD_FIELDS],
    )


def user_profile(users: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(users, keys).select("id", "username", "email", F.col("is_staff").alias("admin"))


def visible_orders(orders: DataFrame, viewers: DataFrame) -> DataFrame:
    """Orders each viewer (user_id, is_staff) sees.

    Every staff viewer sees the same list, so it appears once, with scope
    ``staff`` and no viewer; other viewers get their own orders, scope ``own``.
    """
    mine = owned_by(orders, viewers.filter(~F.col("is_staff"))).select(
        F.lit("own").alias("scope"), F.col("user_id").alias("viewer_id"), *orders.columns
    )
    if not viewers.filter("is_staff").limit(1).count():
        return mine
    everything = orders.select(F.lit("staff").alias("scope"), F.lit(None).cast("long").alias("viewer_id"), "*")
    return everything.unionByName(mine)


def orders_for(orders: DataFrame, user_id: int, is_staff: bool) -> DataFrame:
    """One viewer's orders; the ownership filter reaches the scan."""
    return orders if is_staff else orders.filter(F.col("user_id") == user_id)


def order_listing(orders: DataFrame, correct_spelling: bool = False) -> DataFrame:
    return orders.select(
        "id", "name", "card_number", "address", "ordered_item", "paid_status",
        text.display_date("paid_at", correct_spelling).alias("paid_on"),
        F.concat(F.col("total_price").cast("string"), F.lit(" INR")).alias("amount"),
        "is_delivered", "delivered_at",
        F.when(F.col("is_delivered"), "Mark as Undelivered").otherwise("Mark as delivered").alias("delivery_action"),
    )


def formatted_addresses(addresses: DataFrame, style: str = "order") -> DataFrame:
    line = text.format_address("house_no", "landmark", "city", "state", "pin_code", style)
    return addresses.select("id", "user_id", line.alias("address"))


def admin_listing(table: DataFrame, kind: str) -> DataFrame:
    return table.select(*ADMIN_COLUMNS[kind])
