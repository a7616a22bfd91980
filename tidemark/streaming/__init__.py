"""Structured Streaming wrappers of the batch operators."""
