"""All registered queries."""

from formulake.plans import q_anchor, q_clean, q_joins, q_models, q_sources, q_stats, q_streams, q_text, q_views  # noqa: F401
from formulake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
