"""Structured Streaming variant of resumable scoring."""
