"""Registered queries."""

from . import queries  # noqa: F401
from . import eval_queries, live_queries, log_queries  # noqa: F401  isort: skip
