"""Queries over the given tables. Importing this package registers all of them."""

from attestra.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

from attestra.plans import text_functions  # noqa: E402,F401
from attestra.plans import source_queries  # noqa: E402,F401
from attestra.plans import table_queries  # noqa: E402,F401
from attestra.plans import search_queries  # noqa: E402,F401
from attestra.plans import ref_queries  # noqa: E402,F401
from attestra.plans import result_queries  # noqa: E402,F401
from attestra.plans import verify_queries  # noqa: E402,F401
from attestra.plans import ingest_queries  # noqa: E402,F401
