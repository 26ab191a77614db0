"""Incremental comparison of streams of changes."""
