"""Structured Streaming forms of operators that a live system runs day by day."""
