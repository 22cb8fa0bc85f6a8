"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with equivalent SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records like nominations, made from orders: same text for Spark and the oracle, as it is input and not operator.
RECORDS = """
SELECT o_orderkey, o_custkey, o_totalprice,
  'PN' || CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 10 = 3 THEN '-0' WHEN o_orderkey % 10 = 7 THEN '-1' ELSE '' END AS citation,
  CASE o_orderkey % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ben' WHEN 2 THEN 'Carl' ELSE 'Dora' END || ' '
    || upper(substr(translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij'), 1, 1)) || substr(translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij'), 2, 20) || 'son' AS person,
  CASE o_custkey % 5 WHEN 0 THEN 'Ohio' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Maine' WHEN 3 THEN 'Iowa' ELSE 'New York' END AS state,
  CASE o_orderkey % 3 WHEN 0 THEN 'United States District Judge' WHEN 1 THEN 'United States Circuit Judge' ELSE 'United States Attorney' END AS title,
  CASE o_orderkey % 3 WHEN 1 THEN 'Sixth Circuit' ELSE 'Northern District of ' || CASE o_custkey % 5 WHEN 0 THEN 'Ohio' WHEN 1 THEN 'Texas' WHEN 2 THEN 'Maine' WHEN 3 THEN 'Iowa' ELSE 'New York' END END AS court,
  'Gale ' || upper(substr(translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij'), 1, 1)) || substr(translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij'), 2, 20) || 'ton' AS former,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'retired' WHEN '2' THEN 'elevated' WHEN '3' THEN 'deceased' WHEN '4' THEN 'resigned' ELSE 'retiring' END AS reason,
  CAST(o_orderdate AS DATE) AS receiveddate,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) AS actiondate,
  CASE o_orderstatus WHEN 'F' THEN 'Confirmed by the Senate by Yea-Nay Vote. ' || CAST(50 + o_orderkey % 51 AS STRING) || ' - ' || CAST(o_orderkey % 40 AS STRING) || '. Record Vote Number: ' || CAST(o_orderkey AS STRING) || '.'
    WHEN 'O' THEN 'Returned to the President under Rule XXXI.' ELSE 'Confirmed by the Senate by Voice Vote.' END AS action
FROM {orders}
"""
DESCRIBED = f"""
SELECT *, person || ', of ' || state || ', to be ' || title || ' for the ' || court || ', vice ' || former || ', ' || reason || '.' AS description
FROM ({RECORDS}) AS r
"""
WITH = "WITH noms AS (" + DESCRIBED.format(orders="orders") + ") "


def nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DESCRIBED, orders=table(spark, sf_dir, "orders"))
