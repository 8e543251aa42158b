"""The registered queries and their SQL."""

from wattfleet.plans import join_queries, power, sequence_queries, stream_queries  # noqa: F401
from wattfleet.plans.registry import QUERIES, SQL  # noqa: F401
