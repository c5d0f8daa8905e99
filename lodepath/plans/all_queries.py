"""Every query module, imported so that it registers its queries."""

from lodepath.plans import building_queries, coverage_queries, grid_queries, joins, kernel_queries, row_queries, sequence_queries, source_queries, stats, survey_queries, venue_queries
from lodepath.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "building_queries", "coverage_queries", "grid_queries", "joins", "kernel_queries", "row_queries", "sequence_queries", "source_queries", "stats", "survey_queries", "venue_queries"]
