"""Structured Streaming front of the same operators."""
