"""Structured Streaming forms of the scoring and dialogue chains."""
