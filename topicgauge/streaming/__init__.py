"""Scoring documents as they arrive."""
