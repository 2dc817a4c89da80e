"""Row types of the card and shop tables. Column names and types."""

from pyspark.sql import types as T


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CARD = T.StructType(
    [T.StructField("id", T.LongType())]
    + _text("card_id")
    + [T.StructField("user_id", T.LongType())]
    + _text(
        "card_number", "exp_month", "exp_year", "customer_id", "email",
        "address_city", "address_country", "address_state", "address_zip", "name_on_card",
    )
)

ADDRESS = T.StructType(
    [T.StructField("id", T.LongType())]
    + _text("name")
    + [T.StructField("user_id", T.LongType())]
    + _text("phone_number", "pin_code", "house_no", "landmark", "city", "state")
)

ORDER = T.StructType(
    [T.StructField("id", T.LongType())]
    + _text("name", "ordered_item", "card_number", "address")
    + [
        T.StructField("paid_status", T.BooleanType()),
        T.StructField("paid_at", T.TimestampType()),
        T.StructField("total_price", T.DecimalType(8, 2)),
        T.StructField("is_delivered", T.BooleanType()),
    ]
    + _text("delivered_at")
    + [T.StructField("user_id", T.LongType())]
)

PRODUCT = T.StructType(
    [T.StructField("id", T.LongType())]
    + _text("name", "description")
    + [T.StructField("price", T.DecimalType(8, 2)), T.StructField("stock", T.BooleanType())]
    + _text("image")
)

USER = T.StructType(
    [T.StructField("id", T.LongType())]
    + _text("username", "email")
    + [T.StructField("is_staff", T.BooleanType())]
)

TABLES = {
    "card": CARD,
    "address": ADDRESS,
    "order": ORDER,
    "product": PRODUCT,
    "user": USER,
}

KEY_COLS = ["id", "user_id"]
