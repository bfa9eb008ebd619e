"""Structured Streaming form of the bar upsert."""
