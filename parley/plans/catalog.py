"""All registered queries (importing the query modules fills the registry)."""

from parley.plans import q_history, q_io, q_messages, q_privacy, q_search, q_stream  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
