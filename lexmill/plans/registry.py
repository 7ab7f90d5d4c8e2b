"""Every query by name, with the SQL it must agree with."""

from __future__ import annotations

from lexmill.plans import aggregates, classify, entities, extra, functions, merging, relational, search, streaming
from lexmill.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "classify", "entities", "extra", "functions", "merging", "relational", "search", "streaming"]
