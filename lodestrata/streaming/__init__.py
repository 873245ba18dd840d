"""Structured Streaming forms of the stateless and keyed operators."""
