"""Registered queries over the shared tables (see ``registry``)."""

from . import (feature_queries, io_queries, lookup_queries, metric_queries, model_queries,  # noqa: F401
               monitor_queries, stream_queries, text_queries)
from .registry import ORACLES, QUERIES, SURVEY_IDS, inline_views  # noqa: F401
