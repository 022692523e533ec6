"""All registered queries."""

from curvecal.plans import (  # noqa: F401
    catalog_curves, catalog_metrics, catalog_models, catalog_sources, catalog_studies,
)
from curvecal.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
