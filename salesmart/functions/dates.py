"""Calendar columns.  The week starts on Monday = 0 everywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def weekend(column: str | Column) -> Column:
    """1 on Saturday and Sunday; 0 otherwise, also for a null date."""
    return F.coalesce(F.weekday(_col(column)) >= 5, F.lit(False)).cast("int")


def late_month(column: str | Column) -> Column:
    """1 from the 25th of the month on."""
    return F.coalesce(F.dayofmonth(_col(column)) >= 25, F.lit(False)).cast("int")


def late_quarter(column: str | Column) -> Column:
    """1 from the 25th of a quarter's last month on."""
    day = _col(column)
    closing = (F.month(day) % 3 == 0) & (F.dayofmonth(day) >= 25)
    return F.coalesce(closing, F.lit(False)).cast("int")


def is_first_day(column: str | Column, unit: str) -> Column:
    """1 on the first day of the month, quarter or year."""
    day = _col(column).cast("date")
    return F.coalesce(day == F.trunc(day, unit), F.lit(False)).cast("int")


def is_last_day(column: str | Column, unit: str) -> Column:
    """1 on the last day of the month, quarter or year."""
    day = _col(column).cast("date")
    tomorrow = F.date_add(day, 1)
    return F.coalesce(tomorrow == F.trunc(tomorrow, unit), F.lit(False)).cast("int")


def calendar(column: str | Column, *names: str) -> dict[str, Column]:
    """The named calendar parts of a date, ready for ``withColumns``."""
    day = _col(column)
    parts = {
        "year": lambda: F.year(day),
        "month": lambda: F.month(day),
        "quarter": lambda: F.quarter(day),
        "day_of_week": lambda: F.weekday(day),
        "day_of_month": lambda: F.dayofmonth(day),
        "day_of_year": lambda: F.dayofyear(day),
        "week_of_year": lambda: F.weekofyear(day),
        "is_weekend": lambda: weekend(day),
        "is_late_month": lambda: late_month(day),
        "is_late_quarter": lambda: late_quarter(day),
        "is_month_start": lambda: is_first_day(day, "month"),
        "is_month_end": lambda: is_last_day(day, "month"),
        "is_quarter_start": lambda: is_first_day(day, "quarter"),
        "is_quarter_end": lambda: is_last_day(day, "quarter"),
        "is_year_start": lambda: is_first_day(day, "year"),
        "is_year_end": lambda: is_last_day(day, "year"),
    }
    return {name: parts[name]() for name in names}


def cyclical(column: str | Column) -> dict[str, Column]:
    """Month and weekday as points on a circle."""
    day = _col(column)
    month = F.lit(2 * math.pi) * F.month(day) / F.lit(12)
    weekday = F.lit(2 * math.pi) * F.weekday(day) / F.lit(7)
    return {
        "month_sin": F.sin(month),
        "month_cos": F.cos(month),
        "day_of_week_sin": F.sin(weekday),
        "day_of_week_cos": F.cos(weekday),
    }


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    """Whole days that have passed between two moments (rounded down)."""
    micros = F.timestamp_diff("MICROSECOND", _col(earlier), _col(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def shifted_month(year: Column, month: Column, by: int) -> dict[str, Column]:
    """Year and month number ``by`` months away."""
    index = year * 12 + month - 1 + by
    return {"year": F.floor(index / 12).cast("int"), "month": (F.pmod(index, F.lit(12)) + 1).cast("int")}
