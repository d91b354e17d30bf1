"""Structured Streaming versions of intake, windows and upsert."""
