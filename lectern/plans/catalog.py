"""All registered queries."""
from . import (  # noqa: F401
    cause_queries,
    claim_queries,
    context_queries,
    layout_queries,
    retrieval_queries,
    score_queries,
    source_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
