"""All queries by name, and the equivalent SQL."""

from __future__ import annotations

from importlib import import_module

from tidewater.plans.base import ORACLE, QUERIES

for _name in ("text_queries", "manifest_queries", "relational_queries", "series_queries", "alignment_queries", "number_queries", "speaker_queries", "stream_queries", "more_queries", "last_queries", "utterance_queries", "speech_queries"):
    import_module(f"tidewater.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
