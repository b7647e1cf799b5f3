"""Named queries over the star-schema tables, each with its reference SQL where SQL can state it."""

from tidemark.registry.base import QUERIES, SQL

from tidemark.registry import basics, findings, forecasts, joins, landing, modules, pairs, seasons, tests_of_series  # noqa: F401  (each module registers its queries)

__all__ = ["QUERIES", "SQL"]
