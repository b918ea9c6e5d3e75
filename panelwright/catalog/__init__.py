"""All registered queries; importing a module registers its queries."""

from panelwright.catalog import (  # noqa: F401
    asof_queries,
    portfolio_queries,
    ranking_queries,
    feature_queries,
    model_check_queries,
    model_queries,
    quality_queries,
    source_queries,
    split_queries,
    stats_queries,
    view_queries,
)
from panelwright.catalog.registry import ORACLE, QUERIES  # noqa: F401
