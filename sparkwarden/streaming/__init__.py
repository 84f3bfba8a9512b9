"""Structured Streaming forms of the trace and command operators."""
