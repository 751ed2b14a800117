"""A PySpark-native engine for multi-source listing data."""
