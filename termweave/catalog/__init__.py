"""Registered queries over the driver tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from .registry import QUERIES, SQL, Inputs  # noqa: F401
from . import dag_queries, graph_queries, label_queries, metric_queries  # noqa: F401
from . import plan_queries, quality_queries, ranking_queries, source_queries, text_queries  # noqa: F401
