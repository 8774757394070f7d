"""Structured Streaming forms of the continuous work."""
