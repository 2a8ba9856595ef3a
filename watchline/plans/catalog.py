"""All queries over the event tables; importing the modules registers them."""

from watchline.plans import queries_events, queries_functions, queries_more, queries_questions, queries_records, queries_reports, queries_state, queries_streams, queries_tracking  # noqa: F401
from watchline.plans.base import REGISTRY

__all__ = ["REGISTRY"]
