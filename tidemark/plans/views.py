"""Research inputs as views over the provided tables, in SQL that Spark and DuckDB both run. {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "bars": """SELECT l_partkey AS code, CAST(l_shipdate AS DATE) AS trade_date, round((min(l_extendedprice / l_quantity) + max(l_extendedprice / l_quantity)) / 2, 7) AS open,
  round(max(l_extendedprice / l_quantity), 7) AS high, round(min(l_extendedprice / l_quantity), 7) AS low, round(avg(l_extendedprice / l_quantity), 7) AS close,
  sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)""",
    "actions": """SELECT code, ex_date, action_type, concat(CAST(code AS STRING), '|', CAST(ex_date AS STRING), '|', action_type) AS record_id, max(ratio) AS ratio, max(price) AS price,
  CASE WHEN max(dropped) = 1 THEN 'CANCELLED' ELSE 'ANNOUNCED' END AS action_status FROM (
  SELECT l_partkey AS code, CAST(l_shipdate AS DATE) AS ex_date, CASE WHEN l_linenumber = 6 THEN 'SPLIT' WHEN l_returnflag = 'A' THEN 'CASH' WHEN l_returnflag = 'N' THEN 'STOCK' ELSE 'RIGHTS' END AS action_type,
    CASE WHEN l_linenumber = 6 THEN 2.0E0 WHEN l_returnflag = 'A' THEN l_tax ELSE l_discount END AS ratio, l_extendedprice / l_quantity AS price,
    CASE WHEN l_linestatus = 'O' AND l_partkey % 7 = 0 THEN 1 ELSE 0 END AS dropped FROM {lineitem} WHERE l_discount >= 0.08) x GROUP BY code, ex_date, action_type""",
    "master": """SELECT p_partkey AS code, CASE WHEN p_size = 50 THEN NULL ELSE p_brand END AS industry, p_type AS board, p_size, p_retailprice,
  CASE WHEN p_partkey % 23 = 0 THEN 'B_SHARE' ELSE 'A_SHARE' END AS security_type, CASE WHEN p_partkey % 29 = 0 THEN 'USD' ELSE 'CNY' END AS currency,
  CASE p_partkey % 5 WHEN 0 THEN 'MAIN_SH' WHEN 1 THEN 'STAR' WHEN 2 THEN 'MAIN_SZ' WHEN 3 THEN 'CHINEXT' ELSE 'BSE' END AS venue FROM {part}""",
    "filings": """SELECT o_orderkey AS filing_id, o_custkey AS entity, CAST(o_orderdate AS DATE) AS published_at, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS DATE) AS valid_from,
  CASE WHEN o_orderkey % 170 = 0 THEN NULL ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes_id,
  CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'O' THEN 'DERIVED' ELSE 'UNVERIFIED' END AS quality_status FROM {orders}""",
    "facts": """SELECT DISTINCT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS fact_id, l_orderkey AS filing_id, l_linenumber AS raw_name,
  CASE l_linenumber WHEN 1 THEN 'assets' WHEN 2 THEN 'liabilities' WHEN 3 THEN 'equity' WHEN 4 THEN 'revenue' WHEN 5 THEN 'net_profit' WHEN 6 THEN 'operating_cash_flow' END AS name,
  l_extendedprice AS value, CASE WHEN l_tax > 0.04 THEN 0 ELSE 2 END AS decimals, CASE l_returnflag WHEN 'A' THEN 'CONFLICT' WHEN 'N' THEN 'VALID' ELSE 'DERIVED' END AS quality_status FROM {lineitem}""",
    "factors": """SELECT l_partkey AS code, avg(l_discount) AS f1, avg(l_tax) AS f2, CASE WHEN count(*) >= 12 THEN round(sum(l_extendedprice), 2) END AS f3, sum(l_quantity) AS f4,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE round(max(l_extendedprice), 2) END AS f5, CAST(max(l_linenumber) AS DOUBLE) AS f6 FROM {lineitem} GROUP BY l_partkey""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


#: Marks SQL that needs WITH RECURSIVE. SQL that begins with + goes on with tables of its own after the views.
RECURSE = "/*RECURSE*/"


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB, preceded by the views it reads."""
    views = ", ".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in names)
    body = sql.replace(RECURSE, "").lstrip()
    more = ", " if body.startswith("+") else " "
    return f"WITH {'RECURSIVE ' if RECURSE in sql else ''}{views}{more}{body.lstrip('+')}"
