"""Structured Streaming versions of the polling jobs."""
