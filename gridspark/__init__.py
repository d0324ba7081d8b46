"""Spark-native analytics for large run-length encoded cell grids."""
