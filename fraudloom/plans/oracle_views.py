"""SQL texts of the card and shop views, for the checks in DuckDB."""

from __future__ import annotations

from fraudloom.sources import fixtures

_NAMES = ("orders", "customer", "nation", "region", "lineitem", "part")
_PLAIN = {n: n for n in _NAMES}

TX = fixtures._TRANSACTIONS.format(**_PLAIN).replace("string", "varchar")
ORDERS = fixtures._ORDERS.format(**_PLAIN).replace("string", "varchar")

PRODUCTS = """
SELECT p_partkey AS id, p_name AS name, p_type AS description, cast(p_retailprice AS decimal(8,2)) AS price,
       p_size % 3 <> 0 AS stock, cast(NULL AS varchar) AS image
FROM part
"""

USERS = """
SELECT c_custkey AS id, c_name AS username,
       concat('user', cast(c_custkey AS varchar), '@', lower(c_mktsegment), '.example.com') AS email,
       c_custkey % 100 = 0 AS is_staff
FROM customer
"""

ADDRESSES = """
SELECT c_custkey AS id, c_name AS name, c_custkey AS user_id,
       CASE WHEN c_custkey % 40 = 0 THEN '12ab' ELSE cast(9000000000 + c_custkey AS varchar) END AS phone_number,
       lpad(cast(c_custkey % 1000000 AS varchar), 6, '0') AS pin_code,
       concat('House ', cast(c_custkey AS varchar)) AS house_no, 'shop' AS landmark,
       concat('City ', cast(c_custkey % 200 AS varchar)) AS city, n_name AS state
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS = {"tx": TX, "shop_orders": ORDERS, "shop_products": PRODUCTS, "shop_users": USERS, "shop_addresses": ADDRESSES}


def r6(expr: str, alias: str | None = None, digits: int = 6) -> str:
    return f"round(cast({expr} AS double), {digits}) + 0.0 AS {alias or expr}"


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in views]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


NUM = "coalesce(try_cast({c} AS double), {d})"
SECOND = "CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) END"

# Card rows with the counts of every group, in the raw and the filled variant.
FILLED = f"""
SELECT * REPLACE (coalesce(address_country, 'Unknown') AS address_country,
                  coalesce(address_state, 'Unknown') AS address_state,
                  coalesce(email, 'unknown@unknown.com') AS email),
       {SECOND.replace('email', "coalesce(email, 'unknown@unknown.com')")} AS email_domain
FROM tx
"""

GUARDED = f"SELECT *, coalesce({SECOND}, 'unknown') AS email_domain FROM tx"


def grouped(source: str, measures: list[tuple[str, str, str]]) -> str:
    """``source`` rows with (out, key, aggregate) columns; null keys stay null."""
    joins, columns = [], []
    for i, (out, key, agg) in enumerate(measures):
        joins.append(
            f"LEFT JOIN (SELECT {key} AS k{i}, {agg} AS {out} FROM {source} GROUP BY {key}) g{i} ON s.{key} = g{i}.k{i}"
        )
        columns.append(f"g{i}.{out}")
    return f"SELECT s.*, {', '.join(columns)} FROM {source} s " + "\n".join(joins)


def code(source: str, column: str) -> str:
    """Subquery text mapping values of a column to sorted 0-based codes."""
    return (
        f"(SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS code "
        f"FROM (SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL))"
    )


def scaled(source: str, columns: list[str], keys: str = "id, user_id") -> str:
    """Standardised columns; a constant column becomes 0."""
    cols = ", ".join(
        f"({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
        f"ELSE stddev_pop({c}) OVER () END) AS {c}"
        for c in columns
    )
    return f"SELECT {keys}, {cols} FROM {source}"
