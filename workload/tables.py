"""The given TPC-H-like tables seen as order headers and order lines.

Both builders take the columns the caller needs and join only the tables that
supply them, so a query that never looks at products does not read ``part``.
No join is hinted: Spark broadcasts a side when its size on disk is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with AQE skew handling)
when it is not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schemas import HEADERS, LINES

# fixed values: order priority -> transaction type
TYPE_OF_PRIORITY = {
    "1-URGENT": "sal_soe",
    "2-HIGH": "sal_soc",
    "3-MEDIUM": "sal_inv",
    "4-NOT SPECIFIED": "sal_quo",
    "5-LOW": "sal_cn",
}

CUSTOMER_COLUMNS = {"party_desc", "staff_code"}
NATION_COLUMNS = {"companyfn", "deptunit_code", "deptunit_desc", "amount_forex",
                  "curr_rate_forex_f_calc", "salestaxpct"}
REGION_COLUMNS = {"location_code"}
FROM_HEADER = {"companyfn", "tag_table_usage", "party_unique", "party_code", "party_desc",
               "staff_code", "staff_unique", "deptunit_code", "location_code"}
PART_COLUMNS = {"stkcode_desc", "brand_code", "brand_desc", "stkcate_code", "stkcate_desc",
                "price_unitlist_local"}
SUPPLIER_COLUMNS = {"stkvendor_desc"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str | Column) -> Column:
    return F.col(column).cast("decimal(18,2)") if isinstance(column, str) else column.cast("decimal(18,2)")


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit("y")).otherwise(F.lit("n"))


def _project(df: DataFrame, exprs: dict[str, Column], schema, names: set[str]) -> DataFrame:
    """Keep the wanted columns in schema order; those without a source are null."""
    return df.select(*[
        exprs.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields if f.name in names
    ])


def headers(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    need = set(columns) if columns is not None else set(HEADERS.fieldNames())
    df = table(spark, sf_dir, "orders")
    if need & (CUSTOMER_COLUMNS | NATION_COLUMNS | REGION_COLUMNS):
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if need & (NATION_COLUMNS | REGION_COLUMNS):
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if need & REGION_COLUMNS:
        df = df.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    kind = F.create_map(*[F.lit(x) for pair in TYPE_OF_PRIORITY.items() for x in pair])
    rate = F.lit(1.0) + F.lit(0.5) * F.col("n_regionkey")
    exprs = {
        "idcode": F.col("o_orderkey"),
        "uniquenum_pri": F.col("o_orderkey"),
        "companyfn": F.concat(F.lit("C"), F.col("n_regionkey")),
        "dnum_auto": F.concat(F.lit("SO"), F.col("o_orderkey")),
        "tag_table_usage": F.element_at(kind, F.col("o_orderpriority")),
        "party_unique": F.col("o_custkey"),
        "party_code": F.concat(F.lit("CU"), F.col("o_custkey")),
        "party_desc": F.col("c_name"),
        "date_trans": F.col("o_orderdate"),
        "date_due": F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"),
        "amount_local": _money("o_totalprice"),
        "amount_forex": _money("o_totalprice").cast("double") / rate,
        "curr_rate_forex_f_calc": rate,
        "deptunit_code": F.col("n_nationkey"),
        "deptunit_desc": F.col("n_name"),
        "staff_code": F.col("c_mktsegment"),
        "location_code": F.col("r_name"),
        "tag_void_yn": _flag(F.col("o_orderkey") % 20 == 0),
        "tag_deleted_yn": _flag(F.col("o_orderkey") % 33 == 0),
        "tag_closed02_yn": _flag(F.col("o_orderstatus") == "F"),
        "salestaxpct": F.lit(5) + F.col("n_regionkey"),
    }
    return _project(df, exprs, HEADERS, need)


def lines(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    need = set(columns) if columns is not None else set(LINES.fieldNames())
    df = table(spark, sf_dir, "lineitem").withColumn("uniquenum_pri", F.col("l_orderkey").cast("string"))
    inherited = sorted(need & FROM_HEADER)
    if inherited:
        df = df.join(headers(spark, sf_dir, ["uniquenum_pri", *inherited]), "uniquenum_pri")
    if need & PART_COLUMNS:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if need & SUPPLIER_COLUMNS:
        df = df.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))

    amount = _money("l_extendedprice") * (F.lit(1).cast("decimal(2,0)") - F.col("l_discount").cast("decimal(4,2)"))
    exprs = {name: F.col(name) for name in inherited} | {
        "idcode": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "uniquenum_uniq": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      F.date_format("l_shipdate", "yyyyMMdd")),
        "uniquenum_pri": F.col("uniquenum_pri"),
        "row_item_num": F.col("l_linenumber"),
        "stkcode_unique": F.col("l_partkey"),
        "stkcode_code": F.concat(F.lit("P"), F.col("l_partkey")),
        "stkcode_desc": F.col("p_name"),
        "brand_code": F.col("p_brand"),
        "brand_desc": F.col("p_brand"),
        "stkcate_code": F.col("p_type"),
        "stkcate_desc": F.col("p_type"),
        "stkvendor_code": F.col("l_suppkey"),
        "stkvendor_desc": F.col("s_name"),
        "qnty_total": F.col("l_quantity"),
        "qnty_uomstk": F.col("l_quantity"),
        "bal_qnty_total": F.col("l_quantity"),
        "bal_qnty_uomstk": F.col("l_quantity"),
        "price_unitlist_local": _money("p_retailprice"),
        "price_unitrate_local": F.col("l_extendedprice") / F.col("l_quantity"),
        "discount_pct": F.col("l_discount").cast("decimal(4,2)") * 100,
        "amount_local": amount,
        "amount_tax_local": amount * F.col("l_tax").cast("decimal(4,2)"),
        "date_trans": F.col("l_shipdate"),
        "tag_void_yn": _flag(F.col("l_returnflag") == "R"),
        "tag_closedmain_yn": _flag(F.col("l_linestatus") == "F"),
    }
    return _project(df, exprs, LINES, need)


def dirty_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with gaps, unreadable amounts and dates, and negative credit notes."""
    df = headers(spark, sf_dir)
    key = F.col("idcode")
    signed = F.when(F.col("tag_table_usage") == "sal_cn", -F.col("amount_local")).otherwise(F.col("amount_local"))
    return df.withColumns({
        "party_desc": F.when(key % 7 != 0, F.col("party_desc")),
        "deptunit_desc": F.when(key % 11 != 0, F.col("deptunit_desc")),
        "staff_code": F.when(key % 13 != 0, F.col("staff_code")),
        "amount_local": F.when(key % 17 == 0, F.lit("n/a")).otherwise(signed.cast("string")),
        "date_trans": F.when(key % 19 == 0, F.lit("bad")).otherwise(F.date_format("date_trans", "yyyy-MM-dd")),
    })


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with missing brands, categories and product identifiers, and unreadable numbers."""
    df = lines(spark, sf_dir)
    key = F.col("stkcode_unique").cast("long")
    return df.withColumns({
        "brand_desc": F.when(key % 10 != 0, F.col("brand_desc")),
        "stkcate_desc": F.when(key % 15 != 0, F.col("stkcate_desc")),
        "stkcode_unique": F.when(key % 23 != 0, F.col("stkcode_unique")),
        "amount_tax_local": F.when(key % 9 == 0, F.lit("n/a")).otherwise(F.col("amount_tax_local").cast("string")),
        "price_unitlist_local": F.when(key % 8 != 0, F.col("price_unitlist_local").cast("string")).otherwise(F.lit("")),
    })


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One business question per order, about the order's month or year."""
    df = headers(spark, sf_dir, ["idcode", "companyfn", "date_trans"])
    when = F.col("date_trans")
    year, month = F.date_format(when, "yyyy"), F.date_format(when, "M")
    templates = [
        F.concat(F.lit("Show me revenue for "), F.date_format(when, "MMMM"), F.lit(" "), year),
        F.concat(F.lit("revenue "), F.date_format(when, "MM"), F.lit("/"), year),
        F.concat(F.lit("revenue report "), month, F.lit("."), year),
        F.concat(F.lit("revenue "), year),
        F.concat(F.lit("top customers "), month, F.lit("/"), year),
        F.lit("bestseller by category"),
        F.lit("monthly growth"),
        F.lit("sales trend"),
        F.concat(F.lit("hello there"), F.when(F.col("idcode") % 2 == 1, F.concat(F.lit("\nrevenue "), year)).otherwise("")),
    ]
    text = F.element_at(F.array(*templates), (F.col("idcode") % len(templates) + 1).cast("int"))
    return df.select("companyfn", F.col("idcode").alias("prompt_id"), text.alias("prompt"), when.alias("asked_at"))
