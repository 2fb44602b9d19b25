"""Batch operators over event, chunk, text and draft tables."""
