"""Bins, labels and the RFM segment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels
FIVE_LEVELS = ["Very Low", "Low", "Medium", "High", "Very High"]
THREE_LEVELS = ["Low", "Medium", "High"]
SEGMENTS = ["At Risk", "Needs Attention", "Potential Loyalist", "Champion"]
RISK_LEVELS = ["Low", "Medium", "High", "Very High"]
RISK_EDGES = [0, 30, 60, 90]


def labelled(bucket: Column, labels: list[str]) -> Column:
    """Label of a 1-based bucket number."""
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), bucket)


def bucket_of(value: Column, edges: Column, k: int) -> Column:
    """1 + the number of interior edges below ``value`` (right-closed buckets)."""
    above = [F.when(value > F.element_at(edges, i), 1).otherwise(0) for i in range(1, k)]
    return F.when(value.isNotNull(), F.lit(1) + reduce(Column.__add__, above))


def rank_bucket(index: Column, size: Column, k: int) -> Column:
    """Quantile bucket of the row at 0-based ``index`` among ``size`` ranked rows.

    Edges fall at fractions of ``size - 1``, so this differs from ntile.
    """
    # ceil(index * k / (size - 1)) in whole numbers
    upper = index * k + F.greatest(size - 2, F.lit(0))
    step = F.floor(upper / F.greatest(size - 1, F.lit(1)))
    return F.greatest(F.lit(1), step).cast("int")


def risk_of(days: Column, include_lowest: bool = False) -> Column:
    """Risk label by days since the last purchase; day 0 lies outside unless asked for."""
    low = (days >= RISK_EDGES[0]) if include_lowest else (days > RISK_EDGES[0])
    return (
        F.when(low & (days <= RISK_EDGES[1]), RISK_LEVELS[0])
        .when((days > RISK_EDGES[1]) & (days <= RISK_EDGES[2]), RISK_LEVELS[1])
        .when((days > RISK_EDGES[2]) & (days <= RISK_EDGES[3]), RISK_LEVELS[2])
        .when(days > RISK_EDGES[3], RISK_LEVELS[3])
    )


def segment_of(score_sum: Column) -> Column:
    """Customer segment from the sum of the three RFM scores.

    The bins (0,2], (2,3], (3,4], (4,5] of the mean are compared on the
    integer sum, where no rounding can move a customer across an edge.
    """
    return (
        F.when(score_sum <= 6, SEGMENTS[0])
        .when(score_sum <= 9, SEGMENTS[1])
        .when(score_sum <= 12, SEGMENTS[2])
        .when(score_sum <= 15, SEGMENTS[3])
    )


def churned(days: Column, threshold: int) -> Column:
    """1 when more than ``threshold`` days have passed."""
    return (days > threshold).cast("int")
