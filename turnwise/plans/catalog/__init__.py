"""All registered queries."""

from . import (  # noqa: F401
    ablation_queries,
    evaluation_queries,
    governance_queries,
    memory_queries,
    mining_queries,
    reply_queries,
    pass_queries,
    retrieval_queries,
    source_queries,
    turn_queries,
)
from .base import RUNS, SQL

__all__ = ["RUNS", "SQL"]
