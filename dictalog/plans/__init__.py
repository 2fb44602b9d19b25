"""Fixture views and the registry of runnable queries with their SQL oracles."""

from dictalog.plans.registry import QUERIES  # noqa: F401
from dictalog.plans import audio_queries, draft_queries, event_queries, text_queries  # noqa: F401
from dictalog.plans.text_queries import flagship  # noqa: F401
