"""All registered queries."""

from candlewright.plans import q_candles, q_gaps, q_jobs, q_quality, q_streams  # noqa: F401
from candlewright.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
