"""All registered queries."""

from . import (  # noqa: F401
    address_queries, constraint_queries, coverage_queries, entity_queries, link_queries, media_queries, publish_queries, search_queries, source_queries, stream_queries,
    timeline_queries, word_queries,
)
from .registry import REGISTRY, callables, oracles  # noqa: F401
