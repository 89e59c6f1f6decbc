"""All queries of the engine and their SQL."""

from __future__ import annotations

from stratacloud.queries import ORACLE_SQL, QUERIES, aggregates, extensions, functions, ordering, planners, sources, streams, trees  # noqa: F401

FLAGSHIP = "pln_1_visible_points"
