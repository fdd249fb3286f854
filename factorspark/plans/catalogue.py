"""Importing this module registers every query."""

from factorspark.plans.registry import ORACLE, QUERIES  # noqa: F401
from factorspark.plans import (  # noqa: F401
    q_align,
    q_factors,
    q_folds,
    q_library,
    q_performance,
    q_scoring,
    q_sources,
    q_streaming,
    q_windows,
)
