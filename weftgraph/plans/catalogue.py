"""Named queries over the driver's tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from . import funnel_queries, graph_queries, index_queries, ingest_queries, reduction_queries, store_queries, table_queries, upkeep_queries

QUERIES: dict = {**graph_queries.QUERIES, **table_queries.QUERIES, **ingest_queries.QUERIES, **upkeep_queries.QUERIES, **index_queries.QUERIES, **reduction_queries.QUERIES, **store_queries.QUERIES, **funnel_queries.QUERIES}
ORACLES: dict[str, str] = {**graph_queries.ORACLES, **table_queries.ORACLES, **ingest_queries.ORACLES, **upkeep_queries.ORACLES, **index_queries.ORACLES, **reduction_queries.ORACLES, **store_queries.ORACLES, **funnel_queries.ORACLES}
FLAGSHIP = "q_find_callers"
