"""All registered queries."""

from gridlens.plans import catalog_design, catalog_grid, catalog_ingest, catalog_ledger, catalog_study, catalog_text  # noqa: F401
from gridlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
