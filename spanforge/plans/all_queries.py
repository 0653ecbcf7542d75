"""Every query of the engine, by name."""

from spanforge.plans import layout_queries, record_queries, resolve_queries, source_queries, text_queries  # noqa: F401
from spanforge.plans.registry import ORACLES, QUERIES  # noqa: F401
