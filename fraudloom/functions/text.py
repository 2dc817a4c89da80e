"""Column expressions for card, e-mail, date and address text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Month names shown to the shop's users, with their spelling.
MONTHS = {
    "01": "January", "02": "Feburary", "03": "March", "04": "April",
    "05": "May", "06": "June", "07": "July", "08": "August",
    "09": "September", "10": "October", "11": "November", "12": "December",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def email_domain_second(email: Column | str) -> Column:
    """Text between the first and second ``@``; null when there is none."""
    return F.get(F.split(_col(email), "@"), F.lit(1))


def email_domain_last(email: Column | str) -> Column:
    """Text after the last ``@``; the whole text when there is none."""
    return F.element_at(F.split(_col(email), "@"), -1)


def email_domain_guarded(email: Column | str) -> Column:
    return F.coalesce(email_domain_second(email), F.lit("unknown"))


def to_number(text: Column | str, default: float | None = None) -> Column:
    """Text as double; anything that is not a plain number becomes ``default``."""
    c = _col(text).cast("string")
    number = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def card_expiry_months(month: Column | str, year: Column | str, current_year: int) -> Column:
    return (_col(year) - F.lit(current_year)) * 12 + _col(month)


def months_to_expiry(month: Column | str, year: Column | str, current_year: int, current_month: int) -> Column:
    return card_expiry_months(month, year, current_year) - F.lit(current_month)


def blank_to_null(text: Column | str) -> Column:
    return F.nullif(_col(text), F.lit(""))


def keep_if_blank(new: Column | str, old: Column | str) -> Column:
    return F.coalesce(blank_to_null(new), _col(old))


def or_not_set(text: Column | str) -> Column:
    return F.coalesce(blank_to_null(text), F.lit("Not Set"))


def mask_card(number: Column | str) -> Column:
    return F.concat(F.lit("XXXX XXXX XXXX "), F.substring(_col(number), 13, 6))


def last4(number: Column | str, how: str = "slice") -> Column:
    """Characters 13 to 16 (``slice``) or the true last four (``right``)."""
    if how not in ("slice", "right"):
        raise ValueError(f"last4 must be 'slice' or 'right', not {how!r}")
    return F.substring(_col(number), 13, 4) if how == "slice" else F.right(_col(number), F.lit(4))


def display_date(date_text: Column | str, correct_spelling: bool = False) -> Column:
    """``YYYY-MM-DD...`` as ``DD Month YYYY``; null for an unknown month."""
    c = _col(date_text).cast("string")
    names = dict(MONTHS)
    if correct_spelling:
        names["02"] = "February"
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    month = F.try_element_at(table, F.substring(c, 6, 2))
    return F.concat(F.substring(c, 9, 2), F.lit(" "), month, F.lit(" "), F.substring(c, 1, 4))


def format_address(house, landmark, city, state, pin, style: str = "order") -> Column:
    near = F.concat(F.lit("near "), _col(landmark)) if style == "order" else _col(landmark)
    if style not in ("order", "list"):
        raise ValueError(f"style must be 'order' or 'list', not {style!r}")
    return F.concat_ws(", ", _col(house), near, _col(city), _col(state), _col(pin))


def minor_units(amount: Column | str, exact: bool = False) -> Column:
    """Amount in hundredths: truncated double arithmetic, or exact decimals."""
    c = _col(amount)
    if exact:
        return (c.try_cast("decimal(18,2)") * 100).cast("bigint")
    return (c.try_cast("double") * 100).cast("bigint")
