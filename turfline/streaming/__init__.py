"""Structured Streaming variants of point-in-time operators."""
