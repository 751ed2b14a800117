"""Operators on DataFrames: warehouse state, gold views, deduplication, units."""
