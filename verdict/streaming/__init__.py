"""Incremental judging of a growing reply log (Structured Streaming)."""
