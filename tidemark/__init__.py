"""A PySpark-native engine for append-only time-series tables."""
