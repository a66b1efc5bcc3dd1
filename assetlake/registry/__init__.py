"""Registered queries: every operator on stand-in views of the given tables, with an oracle in SQL."""
from assetlake.registry.core import ORACLES, QUERIES  # noqa: F401
from assetlake.registry import (  # noqa: F401
    q_aggregates, q_grids, q_joins, q_ordering, q_projections, q_reports, q_rules, q_sources)
