"""All registered queries of the review operators and their SQL."""

from __future__ import annotations

from gleanery.plans import queries_demand, queries_errors, queries_evaluation, queries_experiments, queries_sampling, queries_sources, queries_text, queries_topics  # noqa: F401
from gleanery.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
