"""Category codes: 0-based positions in the sorted distinct values of a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.operators.key_tables import KeyTable, code_column, fit_key_tables


def fit_codes(df: DataFrame, columns: list[str], labels: dict[str, str] | None = None) -> dict[str, KeyTable]:
    return fit_key_tables(df, [], columns, labels)


def apply_codes(
    df: DataFrame, model: dict[str, KeyTable], columns: list[str], salt_by: list[str], unseen: str = "error"
) -> DataFrame:
    """Replace each column by its code; ``unseen`` is ``error``, ``keep`` or ``null``.

    ``keep`` gives missing and unseen values the next free code.
    """
    if unseen not in ("error", "keep", "null"):
        raise ValueError(f"unseen must be 'error', 'keep' or 'null', not {unseen!r}")
    order = df.columns
    for c in columns:
        code = F.col(code_column(c))
        if unseen == "keep":
            code = F.coalesce(code, F.lit(model[c].profile.distinct).cast("long"))
        elif unseen == "error":
            complaint = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col(c).cast("string")))
            code = F.when(F.col(c).isNotNull() & code.isNull(), complaint.cast("long")).otherwise(code)
        df = model[c].join_to(df, salt_by).withColumn(c, code)
    return df.select(*order)
