"""Checks of change sets against the shop's rules.

Every check returns (accepted, rejects); rejects carry a key and a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A field's limits. ``low`` and ``high`` bound its numeric value."""

    column: str
    pattern: str | None = None
    max_len: int | None = None
    required: bool = False
    low: float | None = None
    high: float | None = None

    def failures(self) -> list[Column]:
        c = F.col(self.column).cast("string")
        name, out = self.column, []
        blank = c.isNull() | (F.trim(c) == "")
        if self.required:
            out.append(F.when(blank, f"{name}: required"))
        if self.max_len is not None:
            out.append(F.when(F.char_length(c) > self.max_len, f"{name}: longer than {self.max_len}"))
        if self.pattern is not None:
            out.append(F.when(~blank & ~c.rlike(f"^(?:{self.pattern})$"), f"{name}: bad format"))
        if self.low is not None:
            number = c.try_cast("double")
            inside = F.coalesce(number.between(self.low, self.high), F.lit(False))
            out.append(F.when(~blank & ~inside, f"{name}: out of range"))
        return out


# Limits of the stored tables.
PRODUCT_RULES = [Rule("name", max_len=200, required=True)]
ADDRESS_RULES = [
    Rule("name", max_len=200, required=True),
    Rule("phone_number", r"\+?1?\d{9,15}", 10, True),
    Rule("pin_code", r"\d{0,9}", 6, True),
    Rule("house_no", max_len=300, required=True),
    Rule("landmark", max_len=120, required=True),
    Rule("city", max_len=120, required=True),
    Rule("state", max_len=120, required=True),
]
# Texts that read as true and as false.
TRUE_TEXTS = ["t", "y", "yes", "true", "on", "1"]
FALSE_TEXTS = ["f", "n", "no", "false", "off", "0"]
CARD_RULES = [
    Rule("card_number", max_len=20),
    Rule("exp_month", r"\d{0,9}", 2),
    Rule("exp_year", r"\d{0,9}", 4),
    Rule("address_zip", r"\d{0,9}", 6),
]


def form_rules(current_year: int) -> dict[str, list[Rule]]:
    """The stricter limits of the entry forms."""
    return {
        "product": [Rule("price", r"[0-9]+(\.[0-9]{1,2})?%?", 8, True)],
        "address": [Rule("phone_number", "[0-9]+", 10), Rule("pin_code", "[0-9]+", 6)],
        "card": [
            Rule("email", r".+@gmail\.com"),
            Rule("card_number", "[0-9]+", 16, True),
            Rule("cvc", "[0-9]+", 3, True),
            Rule("exp_month", low=1, high=12, required=True),
            Rule("exp_year", low=current_year, high=current_year + 20, required=True),
        ],
    }


def split_by_reason(df: DataFrame, failures: list[Column], key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a failure, and (key, reason) with the first failure of the others."""
    judged = df.withColumn("_reason", F.coalesce(*failures, F.lit(None).cast("string")))
    accepted = judged.filter(F.col("_reason").isNull()).drop("_reason")
    rejects = judged.filter(F.col("_reason").isNotNull()).select(key, F.col("_reason").alias("reason"))
    return accepted, rejects


def check(df: DataFrame, rules: list[Rule], key: str = "id") -> tuple[DataFrame, DataFrame]:
    return split_by_reason(df, [f for r in rules for f in r.failures()], key)


def check_every(df: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """(key, reason) for every failed rule, not only the first."""
    found = F.array_compact(F.array(*[f for r in rules for f in r.failures()]))
    return df.select(key, F.explode(found).alias("reason"))


def validate_products(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Name, a price of up to 8 digits with 2 decimals, and a boolean stock."""
    price = F.col("price").cast("string")
    stock = F.lower(F.col("stock").cast("string"))
    plain = price.rlike(r"^\s*[+-]?\d{0,6}(\.\d{0,2})?\s*$") & price.try_cast("decimal(8,2)").isNotNull()
    failures = [f for r in PRODUCT_RULES for f in r.failures()] + [
        F.when(~F.coalesce(plain, F.lit(False)), "price: not a decimal of 8 digits"),
        F.when(~F.coalesce(stock.isin(*TRUE_TEXTS, *FALSE_TEXTS), F.lit(False)), "stock: not a boolean"),
    ]
    accepted, rejects = split_by_reason(df, failures, key)
    return accepted.withColumns(
        {"price": price.try_cast("decimal(8,2)"), "stock": stock.isin(*TRUE_TEXTS)}
    ), rejects


def validate_addresses(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    return check(df, ADDRESS_RULES, key)


def validate_cards(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    return check(df, CARD_RULES, key)


def validate_form_rules(df: DataFrame, kind: str, current_year: int, key: str = "id") -> DataFrame:
    return check_every(df, form_rules(current_year)[kind], key)
