"""Registration, and the dirty inputs that both sides derive by the same SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The standard tables are clean; dirt, and second batches, are derived from keys, in SQL that both engines read.
# Every query runs over whole tables.
DIRTY_ORDERS = """
SELECT concat('t-', CAST(o_orderkey AS STRING)) AS tuple_id, o_orderkey AS _seq, CAST(o_orderkey AS STRING) AS o_orderkey,
  CAST(o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 10000000 ELSE 0 END AS STRING) AS o_custkey,
  CASE WHEN o_orderkey % 31 = 0 THEN 'PX' WHEN o_orderkey % 37 = 0 THEN '  ' WHEN o_orderkey % 61 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '12 apples' WHEN o_orderkey % 47 = 0 THEN '$1,234.50' WHEN o_orderkey % 71 = 0 THEN '-5.25' ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END AS o_totalprice,
  CASE WHEN o_orderkey % 53 = 0 THEN '2024-13-45' WHEN o_orderkey % 59 = 0 THEN '1998/05/07' WHEN o_orderkey % 67 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_orderdate,
  CASE WHEN o_orderkey % 29 = 0 THEN 'maybe' WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'false' END AS o_open,
  CASE WHEN o_orderkey % 23 = 0 THEN CAST(o_orderkey % 7 AS STRING) || 'x' ELSE CAST(o_orderkey % 7 AS STRING) END AS o_items,
  o_orderpriority
FROM {orders}"""
DIRTY_CUSTOMER = """
SELECT concat('t-', CAST(c_custkey AS STRING)) AS tuple_id, c_custkey AS _seq, CAST(c_custkey AS STRING) AS c_custkey,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'null' WHEN c_custkey % 29 = 0 THEN 'customer 1' ELSE c_name END AS c_name,
  CAST(c_nationkey AS STRING) AS c_nationkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS STRING) END AS c_acctbal,
  CASE WHEN c_custkey % 13 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 31 = 0 THEN 'BUILDNG' ELSE c_mktsegment END AS c_mktsegment
FROM {customer}"""
LINES = """
SELECT concat('t-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS tuple_id,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS _seq, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate FROM {lineitem}"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL text with {table} names over the tables of sf_dir."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(sql: str, **more: str) -> str:
    """The same text for DuckDB; more: names of subqueries."""
    out = sql
    for k, v in more.items():
        out = out.replace("{" + k + "}", f"({v})")
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return out


def query(oracle: str | None = None, name: str | None = None, **casts: str):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its oracle.

    casts: SQL types of columns whose sums DuckDB would widen.
    """

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in casts.items())}) FROM ({oracle}) typed" if casts else oracle
            ORACLES[key] = duck(sql, ORD=DIRTY_ORDERS, CUS=DIRTY_CUSTOMER, LIN=LINES)
        return f

    return add
