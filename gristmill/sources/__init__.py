"""Readers, board normalisers and sinks."""
