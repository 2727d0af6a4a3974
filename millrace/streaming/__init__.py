"""Structured Streaming forms of the same transfers."""
