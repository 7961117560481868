"""All registered queries and their SQL."""

from . import queries_blocks, queries_indicators, queries_learning
from .queries import QUERIES, SQL

MODULES = (queries_blocks, queries_indicators, queries_learning)

__all__ = ["QUERIES", "SQL"]
