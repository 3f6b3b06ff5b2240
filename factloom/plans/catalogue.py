"""All queries of the evidence engine."""

from __future__ import annotations

from factloom.plans import evidence_queries, geometry_queries, image_queries, record_queries, row_queries, source_queries, store_queries, text_queries  # noqa: F401  they register themselves
from factloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Recognised lines of every order to released snapshots."""
    return QUERIES["extraction_pipeline"](spark, sf_dir)
