"""Explicit schemas of the two source relations, with a role per column.

The names, types and roles below are fixed values: they are the source
tables' column layout.
"""

from __future__ import annotations

from pyspark.sql import types as T

LONG, STRING, TIMESTAMP = T.LongType(), T.StringType(), T.TimestampNTZType()
MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(18, 8)  # unit prices and exchange rates are quotients


def _fields(rows: list[tuple[str, T.DataType, str]]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, dtype, True, {"role": role}) for name, dtype, role in rows]
    )


# fixed values: order headers, one row per transaction document
HEADERS = _fields([
    ("idcode", LONG, "identifier"),
    ("uniquenum_pri", STRING, "identifier"),
    ("companyfn", STRING, "filter"),
    ("dnum_auto", STRING, "identifier"),
    ("tag_table_usage", STRING, "category"),
    ("party_unique", STRING, "customer_identifier"),
    ("party_code", STRING, "customer_code"),
    ("party_desc", STRING, "customer_name"),
    ("date_trans", TIMESTAMP, "temporal_feature"),
    ("date_due", TIMESTAMP, "temporal_feature"),
    ("amount_local", MONEY, "target_variable"),
    ("amount_forex", MONEY, "target_variable"),
    ("curr_short_forex", STRING, "currency"),
    ("curr_rate_forex_f_calc", RATE, "exchange_rate"),
    ("deptunit_code", STRING, "business_unit"),
    ("deptunit_desc", STRING, "business_unit"),
    ("staff_code", STRING, "salesperson"),
    ("staff_unique", STRING, "salesperson"),
    ("location_code", STRING, "location"),
    ("creditterm_desc", STRING, "payment_terms"),
    ("delivtype_desc", STRING, "delivery_type"),
    ("sendby_desc", STRING, "shipping_method"),
    ("notes_memo", STRING, "text_feature"),
    ("tag_void_yn", STRING, "filter"),
    ("salestaxpct", MONEY, "tax_rate"),
    ("tag_deleted_yn", STRING, "filter"),
    ("tag_closed02_yn", STRING, "status"),
    ("entprojfn_code", STRING, "project"),
])

# fixed values: order lines, uniquenum_pri points to the header
LINES = _fields([
    ("idcode", LONG, "identifier"),
    ("uniquenum_uniq", STRING, "identifier"),
    ("uniquenum_pri", STRING, "foreign_key"),
    ("companyfn", STRING, "filter"),
    ("tag_table_usage", STRING, "category"),
    ("row_item_num", MONEY, "sequence"),
    ("stkcode_code", STRING, "product_code"),
    ("stkcode_unique", STRING, "product_identifier"),
    ("stkcode_desc", STRING, "product_name"),
    ("skucode_code", STRING, "sku"),
    ("brand_code", STRING, "brand"),
    ("brand_unique", STRING, "brand"),
    ("brand_desc", STRING, "brand"),
    ("stkcate_code", STRING, "category"),
    ("stkcate_unique", STRING, "category"),
    ("stkcate_desc", STRING, "category"),
    ("stkvendor_code", STRING, "vendor"),
    ("stkvendor_desc", STRING, "vendor"),
    ("qnty_total", MONEY, "quantity"),
    ("qnty_uomstk", MONEY, "quantity"),
    ("bal_qnty_total", MONEY, "balance_quantity"),
    ("bal_qnty_uomstk", MONEY, "balance_quantity"),
    ("uom_stk_code", STRING, "unit_of_measure"),
    ("price_unitlist_forex", MONEY, "list_price"),
    ("price_unitlist_local", MONEY, "list_price"),
    ("price_unitrate_forex", RATE, "unit_price"),
    ("price_unitrate_local", RATE, "unit_price"),
    ("discount_pct", MONEY, "discount"),
    ("amount_forex", MONEY, "line_amount"),
    ("amount_local", MONEY, "line_amount"),
    ("amount_tax_forex", MONEY, "tax_amount"),
    ("amount_tax_local", MONEY, "tax_amount"),
    ("gst_taxa_code", STRING, "tax_code"),
    ("date_trans", TIMESTAMP, "temporal_feature"),
    ("party_unique", STRING, "customer_identifier"),
    ("party_code", STRING, "customer_code"),
    ("party_desc", STRING, "customer_name"),
    ("staff_code", STRING, "salesperson"),
    ("staff_unique", STRING, "salesperson"),
    ("deptunit_code", STRING, "business_unit"),
    ("location_code", STRING, "location"),
    ("notes_memo", STRING, "text_feature"),
    ("tag_void_yn", STRING, "filter"),
    ("tag_item_taxable_yn", STRING, "tax_flag"),
    ("tag_closedmain_yn", STRING, "status"),
])

# fixed values: transaction type code -> name
TRANSACTION_TYPES = {
    "sal_soe": "Sales Order Entry",
    "sal_soc": "Sales Order Confirmation",
    "sal_inv": "Sales Invoice",
    "sal_quo": "Sales Quotation",
    "sal_cn": "Sales Credit Note",
    "stk_do": "Delivery Order",
    "stk_doc": "Delivery Order Confirmation",
}


def columns_with_role(schema: T.StructType, role: str) -> list[str]:
    """Names of the columns that carry the given role."""
    return [f.name for f in schema.fields if f.metadata.get("role") == role]
