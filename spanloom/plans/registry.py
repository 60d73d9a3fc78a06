"""All registered queries by name, and their DuckDB SQL."""

from __future__ import annotations

from spanloom.plans import redaction_queries, source_queries, trace_queries, usage_queries  # noqa: F401

FLAGSHIP = "M1_waterfall"
QUERIES: dict = dict(trace_queries.QUERIES)
ORACLES: dict[str, str] = dict(trace_queries.ORACLES)
