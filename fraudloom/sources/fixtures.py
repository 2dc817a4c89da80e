"""Card and shop tables seen through the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TRANSACTIONS = """
SELECT o_orderkey AS id,
       concat('card_', cast(o_orderkey AS string)) AS card_id,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL
            WHEN o_orderkey % 50 = 0 THEN o_custkey + 1 ELSE o_custkey END AS user_id,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE concat('4', lpad(cast(o_custkey * 7 + (CASE WHEN o_custkey % 20 = 0
                 THEN o_orderkey % 6 ELSE o_orderkey % 3 END) AS string), 15, '0')) END AS card_number,
       CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN 'xx'
            WHEN o_orderkey % 2 = 0 THEN lpad(cast(o_custkey % 12 + 1 AS string), 2, '0')
            ELSE cast(o_custkey % 12 + 1 AS string) END AS exp_month,
       CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE cast(2023 + o_custkey % 11 AS string) END AS exp_year,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('cus_', cast(o_custkey AS string)) END AS customer_id,
       CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 71 = 0 THEN 'no-at-sign'
            ELSE concat('user', cast(o_custkey AS string), '@',
                 CASE WHEN o_custkey % 25 = 0 THEN 'gmail.com'
                      ELSE concat(lower(c_mktsegment), '.example.com') END) END AS email,
       concat('City ', cast(o_custkey % 200 AS string)) AS address_city,
       CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE r_name END AS address_country,
       CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE n_name END AS address_state,
       lpad(cast((o_custkey * 13 + (CASE WHEN o_custkey % 10 = 0 THEN o_orderkey % 4 ELSE 0 END)) % 99999
            AS string), 5, '0') AS address_zip,
       c_name AS name_on_card
FROM {orders}
JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON n_nationkey = CASE WHEN o_custkey % 10 = 0
     THEN (c_nationkey + o_orderkey % 2) % 25 ELSE c_nationkey END
JOIN {region} ON r_regionkey = n_regionkey
"""

_ORDERS = """
SELECT o_orderkey AS id, c_name AS name, coalesce(p_name, 'Not Set') AS ordered_item,
       right(lpad(cast(o_custkey AS string), 16, '4'), 4) AS card_number,
       concat('House ', cast(o_custkey AS string), ', near shop') AS address,
       o_orderstatus <> 'P' AS paid_status, cast(o_orderdate AS timestamp) AS paid_at,
       cast(o_totalprice AS decimal(8,2)) AS total_price, o_orderstatus = 'F' AS is_delivered,
       CASE WHEN o_orderstatus = 'F' THEN 'Delivered' ELSE 'Not Delivered' END AS delivered_at,
       o_custkey AS user_id
FROM {orders}
JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM {lineitem} GROUP BY l_orderkey)
     ON l_orderkey = o_orderkey
LEFT JOIN {part} ON p_partkey = first_part
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        _TRANSACTIONS,
        orders=_spread(table(spark, sf_dir, "orders"), "o_orderkey"),
        **{n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")},
    )


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Share out a table of fewer files than cores, which one task would read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) * 4 < cores else df


def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name AS name", "p_type AS description",
        "cast(p_retailprice AS decimal(8,2)) AS price", "p_size % 3 <> 0 AS stock",
        "cast(NULL AS string) AS image",
    )


def shop_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS username",
        "concat('user', cast(c_custkey AS string), '@', lower(c_mktsegment), '.example.com') AS email",
        "c_custkey % 100 = 0 AS is_staff",
    )


def shop_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name"), "c_nationkey"
    )
    return named.selectExpr(
        "c_custkey AS id", "c_name AS name", "c_custkey AS user_id",
        "CASE WHEN c_custkey % 40 = 0 THEN '12ab' ELSE cast(9000000000 + c_custkey AS string) END AS phone_number",
        "lpad(cast(c_custkey % 1000000 AS string), 6, '0') AS pin_code",
        "concat('House ', cast(c_custkey AS string)) AS house_no", "'shop' AS landmark",
        "concat('City ', cast(c_custkey % 200 AS string)) AS city", "n_name AS state",
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _ORDERS, "orders", "customer", "lineitem", "part")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.withColumn("ts", df["ts"].cast("timestamp"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
