"""Structured Streaming versions of the daily products."""
