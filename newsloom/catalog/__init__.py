"""Every operator as a query over the given tables, with its SQL counterpart."""

from newsloom.catalog import categories, deduplication, extraction, incremental, inputs, scans
from newsloom.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "categories", "deduplication", "extraction", "incremental", "inputs", "scans"]
