"""Structured Streaming twins of the event-table operators."""
