"""The operators applied to the sample tables, each next to the SQL that must give the same rows."""

from tabwright.plans import (analysis, cleaning, encoding, evaluation, models, neighbours, profiling, scaling,  # noqa: F401
                             selection, sources, tuning)
from tabwright.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
