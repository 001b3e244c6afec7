"""All named queries and their DuckDB SQL."""

from __future__ import annotations

from graphloom.plans import (  # noqa: F401  importing them registers their queries
    browse_queries,
    contract_queries,
    corpus_queries,
    governance_queries,
    governed_queries,
    ledger_queries,
    lifecycle_queries,
    mapping_queries,
    metrics_queries,
    publication_queries,
    resolution_queries,
    retrieval_queries,
    source_queries,
    subgraph_queries,
    xml_queries,
)
from graphloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
