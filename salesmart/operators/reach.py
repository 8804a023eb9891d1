"""How many customers, orders and products: kept as one sketch a month.

Distinct counts do not add up over months, so a report over a year would count
all its documents again.  Sketches of months merge: a refresh makes those of the
months it touches, and any period is read from a few rows a tenant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.distinct import distinct_sketch, estimate, merged_sketch

# fixed values: what is counted, and the header column that tells it
COUNTED = {"customers": "party_unique", "orders": "uniquenum_pri", "salespeople": "staff_code"}


def monthly_reach(headers: DataFrame, counted: dict[str, str] | None = None) -> DataFrame:
    """Sketches per tenant and month of valid headers; one without a date belongs to no month.

    They are kept as text, which every format can hold.
    """
    counted = counted or COUNTED
    dated = headers.where((F.col("tag_void_yn") == "n") & F.col("date_trans").isNotNull())
    return dated.groupBy("companyfn", F.year("date_trans").alias("year"), F.month("date_trans").alias("month")).agg(
        *[F.base64(distinct_sketch(column)).alias(f"{name}_sketch") for name, column in counted.items()])


def reach(months: DataFrame, by: Sequence[str] = ("companyfn", "year")) -> DataFrame:
    """Estimated numbers per ``by`` from the sketches of months."""
    names = [c.removesuffix("_sketch") for c in months.columns if c.endswith("_sketch")]
    return months.groupBy(*by).agg(*[estimate(merged_sketch(F.unbase64(f"{name}_sketch"))).alias(name) for name in names])
