"""Register of runnable queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# the given tables as order headers, in SQL
HDR = """hdr AS (
  SELECT o_orderkey AS okey, CAST(o_orderkey AS VARCHAR) AS uniquenum_pri,
    'C' || n_regionkey AS companyfn, 'SO' || o_orderkey AS dnum_auto,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'sal_soe' WHEN '2-HIGH' THEN 'sal_soc'
      WHEN '3-MEDIUM' THEN 'sal_inv' WHEN '4-NOT SPECIFIED' THEN 'sal_quo'
      WHEN '5-LOW' THEN 'sal_cn' END AS tag_table_usage,
    CAST(o_custkey AS VARCHAR) AS party_unique, 'CU' || o_custkey AS party_code,
    c_name AS party_desc, o_orderdate AS date_trans,
    o_orderdate + INTERVAL 30 DAY AS date_due,
    CAST(o_totalprice AS DECIMAL(18,2)) AS amount_local,
    CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) / (1.0::DOUBLE + 0.5::DOUBLE * n_regionkey)
      AS DECIMAL(18,4)) AS amount_forex,
    1.0::DOUBLE + 0.5::DOUBLE * n_regionkey AS rate,
    CAST(n_nationkey AS VARCHAR) AS deptunit_code, n_name AS deptunit_desc,
    c_mktsegment AS staff_code, r_name AS location_code,
    CASE WHEN o_orderkey % 20 = 0 THEN 'y' ELSE 'n' END AS tag_void_yn,
    CASE WHEN o_orderkey % 33 = 0 THEN 'y' ELSE 'n' END AS tag_deleted_yn,
    CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE 'n' END AS tag_closed02_yn,
    CAST(5 + n_regionkey AS DOUBLE) AS salestaxpct
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# the given tables as order lines, in SQL (needs HDR)
LIN = """lin AS (
  SELECT l_partkey AS pkey, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey
      || '-' || strftime(l_shipdate, '%Y%m%d') AS uniquenum_uniq,
    l_orderkey * 10 + l_linenumber AS idcode,
    h.uniquenum_pri, h.companyfn, h.tag_table_usage, h.party_unique, h.party_code, h.party_desc,
    h.staff_code, h.deptunit_code, h.location_code, l_linenumber AS row_item_num,
    CAST(l_partkey AS VARCHAR) AS stkcode_unique, 'P' || l_partkey AS stkcode_code,
    p_name AS stkcode_desc, p_brand AS brand_code, p_brand AS brand_desc,
    p_type AS stkcate_code, p_type AS stkcate_desc,
    CAST(l_suppkey AS VARCHAR) AS stkvendor_code, s_name AS stkvendor_desc,
    CAST(l_quantity AS DECIMAL(18,4)) AS qnty_total,
    CAST(p_retailprice AS DECIMAL(18,2)) AS price_unitlist_local,
    CAST(l_extendedprice / l_quantity AS DECIMAL(18,8)) AS price_unitrate_local,
    CAST(l_discount AS DECIMAL(4,2)) * 100 AS discount_pct,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      AS DECIMAL(18,4)) AS amount_local,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
      * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS amount_tax_local,
    l_shipdate AS date_trans,
    CASE WHEN l_returnflag = 'R' THEN 'y' ELSE 'n' END AS tag_void_yn,
    CASE WHEN l_linestatus = 'F' THEN 'y' ELSE 'n' END AS tag_closedmain_yn
  FROM lineitem JOIN hdr h ON CAST(l_orderkey AS VARCHAR) = h.uniquenum_pri
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

# valid lines of valid headers of the three order types (needs HDR, LIN)
JOINED = """joined AS (
  SELECT m.companyfn, m.uniquenum_pri, m.party_unique, m.party_code, m.party_desc,
    m.date_trans AS main_date, m.tag_table_usage AS main_type, m.deptunit_code AS main_unit,
    m.staff_code AS main_staff, d.stkcode_code, d.stkcode_desc, d.stkcate_code, d.stkcate_desc,
    d.brand_code, d.brand_desc, d.stkvendor_code, d.stkvendor_desc, d.qnty_total,
    d.price_unitrate_local, d.amount_local AS line_amount
  FROM hdr m JOIN lin d ON m.uniquenum_pri = d.uniquenum_pri AND m.companyfn = d.companyfn
  WHERE m.tag_void_yn = 'n' AND d.tag_void_yn = 'n'
    AND m.tag_table_usage IN ('sal_soe', 'sal_soc', 'sal_inv'))"""


def with_tables(*ctes: str) -> str:
    """``WITH`` clause of the given table expressions."""
    return "WITH " + ",\n".join(ctes) + "\n"


def plain(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Columns in types both engines print alike: no decimals, dates or flags.

    ``digits`` rounds columns whose last bits depend on the order of floating
    point additions (deviations, sines); the SQL rounds them the same way.
    """
    out = []
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            column = column.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.BooleanType):
            column = column.cast("int")
        elif isinstance(f.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        if digits and f.name in digits:
            column = F.round(column, digits[f.name])
        out.append(column.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its check."""
    def register(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
