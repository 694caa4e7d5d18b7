"""All registered queries."""

from threadmill.plans import analytics, records, reports, scalars, streams, texts, written  # noqa: F401  they register their queries
from threadmill.plans.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
