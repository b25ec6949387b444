"""Structured Streaming versions of the usage aggregates."""
