"""All registered queries."""

from gapcube.plans import core_queries, data_queries, design_queries  # noqa: F401
from gapcube.plans.registry import ORACLES, QUERIES  # noqa: F401
