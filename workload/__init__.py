"""The registered queries over the given tables."""

from workload.catalog import ORACLES, QUERIES
from workload import (  # noqa: F401  (importing registers the queries)
    cleaning, declared, extraction, features, insights, jobs, learning, prompts, summaries,
)

__all__ = ["ORACLES", "QUERIES"]
