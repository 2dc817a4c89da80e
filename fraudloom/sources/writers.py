"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "csv", "json", "orc")


def write_report(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write a report in parallel; CSV files carry a header and no index."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format {fmt!r}; use one of {FORMATS}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
