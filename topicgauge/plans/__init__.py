"""Operators put together: comparisons and the full analysis."""
