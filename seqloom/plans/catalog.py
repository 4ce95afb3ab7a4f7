"""All registered queries and their SQL."""

from __future__ import annotations

from . import evaluation_queries, file_queries, model_queries, scan_queries, sequence_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
