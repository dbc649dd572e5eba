"""Incremental builds of the daily models (Structured Streaming, ``foreachBatch``)."""

from seatwise.streaming.daily_build import rebuild_from, start

__all__ = ["rebuild_from", "start"]
