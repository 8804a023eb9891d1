"""Joining a fact with a table of per-key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.session import cut


def attach(fact: DataFrame, figures: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``figures`` (one row per key) to every row of ``fact``.

    ``figures`` is written once to the shared folder, when this is called.
    Spark then knows its true size and chooses the join by it; where both sides
    are shuffled, adaptive execution splits a key that owns much of the fact.

    Without keys ``figures`` is a single row.
    """
    if not keys:
        return fact.crossJoin(F.broadcast(figures))  # an ungrouped aggregate: one row
    return fact.join(cut(figures), keys, how)
