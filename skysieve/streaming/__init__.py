"""Structured Streaming versions of the stateful steps."""
