"""Queries over the driver tables, one module per area."""

from __future__ import annotations

from .registry import QUERIES, Query


def catalogue() -> dict[str, Query]:
    from . import (  # noqa: F401  (each module registers its queries)
        compliance_queries, finding_queries, ranking_queries, retrieval_queries, telemetry_queries, text_queries,
    )

    return dict(QUERIES)
