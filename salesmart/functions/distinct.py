"""Numbers of distinct values: exact, or estimated by sketches that can be merged.

A sketch has a fixed size (2**PRECISION registers of some bits) whatever the
number of values, and sketches of parts merge into the sketch of the whole.
The standard error is 1.04 / sqrt(2**PRECISION), 0.8 %; ``ERROR`` is three times
that.  Sets of up to a few hundred values are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISION = 14
ERROR = 3 * 1.04 / 2 ** (PRECISION / 2)


def distinct_sketch(column: str | Column, precision: int = PRECISION) -> Column:
    """Aggregate: the sketch of a column's distinct values; nulls do not count."""
    column = F.col(column) if isinstance(column, str) else column
    return F.hll_sketch_agg(column.cast("string"), precision)


def merged_sketch(column: str | Column) -> Column:
    """Aggregate: the sketch of all that the given sketches have seen."""
    return F.hll_union_agg(column)


def estimate(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(sketch)


def distinct_count(column: str | Column, approx: bool = False) -> Column:
    """Aggregate: the number of distinct values, from a sketch if ``approx``."""
    return estimate(distinct_sketch(column)) if approx else F.countDistinct(column)
