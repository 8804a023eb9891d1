"""Column helpers for nulls, coercion, value maps and safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or(column: str | Column, default: str) -> Column:
    """The text, or a default label when it is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(default))


def number_or(column: str | Column, default: int = 0, dtype: str = "decimal(18,4)") -> Column:
    """The value as a number; anything unreadable or null becomes ``default``."""
    column = F.col(column) if isinstance(column, str) else column
    number = column.try_cast(dtype)
    if dtype in ("double", "float"):
        number = F.when(~F.isnan(number), number)
    return F.coalesce(number, F.lit(default).cast(dtype))


def moment_or_null(column: str | Column) -> Column:
    """The value as a timestamp without zone; unreadable text becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast("timestamp_ntz")


def mapped(column: str | Column, names: dict[str, str], default: str = "Unknown") -> Column:
    """Look a code up in a small fixed map."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def product_key(code: str = "stkcode_code", unique: str = "stkcode_unique") -> Column:
    """``code_unique``, with N/A and 0 for missing parts."""
    return F.concat_ws("_", F.coalesce(F.col(code), F.lit("N/A")), F.coalesce(F.col(unique), F.lit("0")))


def over_nonzero(numerator: Column, denominator: Column) -> Column:
    """Division in which a zero denominator counts as one."""
    return numerator / F.when(denominator == 0, F.lit(1)).otherwise(denominator)


def over_or_null(numerator: Column, denominator: Column) -> Column:
    """Division in which a zero denominator gives null."""
    return F.try_divide(numerator, denominator)


def as_double_sum(column: str | Column) -> Column:
    """Exact decimal sum (0 for a group of nulls), handed on as double.

    Decimal addition does not depend on the order rows arrive in, so retries
    and repartitioning cannot change the result.
    """
    return F.coalesce(F.sum(column).cast("double"), F.lit(0.0))


def exact_mean(column: str | Column) -> Column:
    """Mean from an exact decimal sum."""
    return F.try_divide(F.sum(column).cast("double"), F.count(column))
