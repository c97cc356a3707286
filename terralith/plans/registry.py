"""Named queries over the driver's tables, with an independent SQL text for each where SQL can express it."""

from __future__ import annotations

FLAGSHIP = "a12_spatial_anomaly"


def _modules():
    from terralith.plans import catalog_queries, evaluation_queries, grid_queries, modelling_queries, spatial_queries, statistics_queries

    return [statistics_queries, evaluation_queries, spatial_queries, grid_queries, modelling_queries, catalog_queries]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
