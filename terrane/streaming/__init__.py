"""Structured Streaming forms of the status operators."""
