"""Structured Streaming over recordings."""
