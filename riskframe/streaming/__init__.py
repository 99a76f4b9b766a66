"""Structured Streaming variant of the timeline features (optional extension)."""
