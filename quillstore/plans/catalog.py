"""All queries and their oracles, collected from the query modules."""

from __future__ import annotations

from . import detail_plans, graph_plans, lifecycle_plans, mining_plans, more_plans, recall_plans, report_plans, store_plans  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
