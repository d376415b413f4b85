"""Structured Streaming form of the sequence index."""
