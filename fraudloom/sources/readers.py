"""Reading card and shop tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# Models of a dump that hold framework state, not data.
SKIPPED_MODELS = ("contenttypes.contenttype", "auth.permission")


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key_col: str = "id",
    n_parts: int = 64,
    columns: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A database table read in ``n_parts`` ranges of ``key_col``.

    The range bounds come from a one-row query that the database answers. Only
    ``columns`` are fetched, and Catalyst pushes later filters into each range.
    """
    base = spark.read.format("jdbc").options(url=url, **(options or {}))
    bounds = base.option("query", f"SELECT MIN({key_col}) AS lo, MAX({key_col}) AS hi FROM {table}").load().first()
    reader = base.option("dbtable", table)
    if bounds["lo"] is not None:
        reader = (
            reader.option("partitionColumn", key_col)
            .option("lowerBound", str(bounds["lo"]))
            .option("upperBound", str(bounds["hi"] + 1))
            .option("numPartitions", str(n_parts))
        )
    df = reader.load()
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """CSV with header under a declared schema, so leading zeros survive."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def require_table(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"Table '{name}' not found")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    """One row per column: position, name, type, nullable."""
    require_table(spark, name)
    return describe_frame(spark.table(name))


def describe_frame(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, column_type string, nullable boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def read_model_dump(
    spark: SparkSession,
    path: str,
    models: dict[str, T.StructType],
    skip: tuple[str, ...] = SKIPPED_MODELS,
    multi_line: bool = True,
) -> dict[str, DataFrame]:
    """Tables held in a JSON dump of ``{model, pk, fields}`` records.

    A dump that is one JSON array cannot be split, so write large dumps one
    record per line and pass ``multi_line=False``.
    """
    raw = T.StructType(
        [
            T.StructField("model", T.StringType()),
            T.StructField("pk", T.LongType()),
            T.StructField("fields", T.StringType()),
        ]
    )
    records = spark.read.schema(raw).option("multiLine", multi_line).json(path)
    out = {}
    for model, schema in models.items():
        if model in skip:
            continue
        typed = records.filter(F.col("model") == model).select(
            F.col("pk").alias("id"), F.from_json("fields", _foreign_keys(schema)).alias("f")
        )
        out[model] = typed.select(
            "id",
            *[F.col(f"f.{_dump_name(f.name)}").alias(f.name) for f in schema.fields if f.name != "id"],
        )
    return out


def _dump_name(column: str) -> str:
    return column[: -len("_id")] if column == "user_id" else column


def _foreign_keys(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(_dump_name(f.name), f.dataType) for f in schema.fields if f.name != "id"])
