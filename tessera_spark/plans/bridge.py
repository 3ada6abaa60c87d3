"""All queries of the engine over the driver's tables, by name."""

from __future__ import annotations

from . import audit_queries, graph_queries, ladder_queries, lookup_queries, pattern_queries, rule_queries, source_queries, state_queries, stream_queries, tool_queries
from .registry import QUERIES, SQL

#: Imported for their registrations.
MODULES = (lookup_queries, ladder_queries, graph_queries, audit_queries, pattern_queries, rule_queries, source_queries, state_queries, stream_queries, tool_queries)
FLAGSHIP = "two_hop_impact"

__all__ = ["FLAGSHIP", "MODULES", "QUERIES", "SQL"]
