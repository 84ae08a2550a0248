"""All registered queries (importing the query modules runs their
``@register`` calls)."""

from verdant.plans import (  # noqa: F401
    queries_models,
    queries_read,
    queries_search,
    queries_stream,
    queries_text,
)
from verdant.plans.catalog import REGISTRY

__all__ = ["REGISTRY"]
