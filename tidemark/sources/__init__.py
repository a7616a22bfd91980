"""Readers of raw inputs and writers with their checks."""
